"""Tables, constants and patterns that decide results.

Everything in this module is data.  It is stated as plain text, in natural
order, so it can be read and checked; no logic lives here.
"""

# --- fixed values: width conversion ------------------------------------------
HALF_KANA = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ"
FULL_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
HALF_VOICED = "ｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎｳ"
FULL_VOICED = "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ"
HALF_SEMI_VOICED = "ﾊﾋﾌﾍﾎ"
FULL_SEMI_VOICED = "パピプペポ"
HALF_VOICE_MARK = "ﾞ"
HALF_SEMI_VOICE_MARK = "ﾟ"
# presentation forms and the ideographic space
WIDTH_EXTRA_FROM = "\ufe19\ufe30\u3000"
WIDTH_EXTRA_TO = "\u2026\u2025 "

# --- fixed values: iteration marks -------------------------------------------
VOICELESS_HIRAGANA = "かきくけこさしすせそたちつてとはひふへほう"
VOICED_HIRAGANA = "がぎぐげござじずぜぞだぢづでどばびぶべぼゔ"
VOICELESS_KATAKANA = "カキクケコサシスセソタチツテトハヒフヘホウ"
VOICED_KATAKANA = "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ"

# --- fixed values: lookup variants, "variant canonical" ----------------------
MULTI_CHAR_FOLD = """
Ⅱ II
Ⅲ III
Ⅳ IV
Ⅵ VI
Ⅶ VII
Ⅷ VIII
Ⅸ IX
Ⅺ XI
Ⅻ XII
ⅱ ii
ⅲ iii
ⅳ iv
ⅵ vi
ⅶ vii
ⅷ viii
ⅸ ix
℃ °C
"""
SINGLE_CHAR_FOLD = """
Ⅰ I
Ⅴ V
Ⅹ X
ⅰ i
ⅴ v
ⅹ x
ゑ え
ヰ イ
况 況
查 査
"""
MEASURED_FOLD = """
㕞刷 㘅啣 㝵碍 䖟蝱 䙝褻 䬒颼 䯻髻 䰗鬮 乾干 亻人
來来 俠侠 册冊 冩写 冫氷 准準 凉涼 凴憑 凾函 刋刊
剝剥 劒劍 勹包 匳奩 匵櫝 卭卬 厶某 后後 噐器 噓嘘
嚮向 囑嘱 囘回 國国 堭隍 壽寿 娬嫵 學学 寫写 寶宝
將将 尸屍 屆届 屬属 峽峡 巤鬣 帋紙 帒袋 并併 彌弥
悋吝 慙慚 懜懵 戀恋 挾挟 捬撫 摑掴 无無 晝昼 會会
朙明 栖棲 樓楼 樷叢 樸朴 欝鬱 氵水 涶唾 渊淵 潛潜
濵濱 灑洒 灣湾 烟煙 燈灯 犭犬 甎磚 甤蕤 畄留 畆畝
當当 癢痒 皃貌 眎視 瞹曖 碯瑙 礟礮 祿禄 禀稟 禦御
禪禅 禮礼 禱祷 秇藝 秌秋 穪稱 竆窮 竒奇 笋筍 簞箪
粮糧 糓穀 纎纖 缻缶 网網 羮羹 耻恥 耼聃 聲声 脉脈
膓腸 舊旧 艪櫓 苢苡 莖茎 萬万 著着 葢蓋 薑姜 蘯蕩
號号 蚦蚺 蜹蚋 蟬蝉 蟲虫 蠶蚕 襍雜 覔覓 觧解 註注
誐哦 賍贓 賷齎 軆体 輓挽 辶辵 迯逃 迹跡 遉偵 遙遥
釐厘 鍫鍬 鏁鎖 閙鬧 隂陰 隖塢 雙双 頣頤 颱台 飃飄
餘余 駞駝 髗顱 髩鬢 鬂鬢 鮧鯷 鵶鴉 鶽隼 鸎鶯 麄粗
麴麹 麸麩 點点 齅嗅 﨑崎
"""

# --- fixed values: combining marks (listed pairs only, not NFC) --------------
COMBINING_VOICED_BASE = "かきくけこさしすせそたちつてとはひふへほ"
COMBINING_VOICED = "がぎぐげござじずぜぞだぢづでどばびぶべぼ"
COMBINING_SEMI_BASE = "はひふへほ"
COMBINING_SEMI = "ぱぴぷぺぽ"
COMBINING_VOICE_MARK = "\u3099"
COMBINING_SEMI_MARK = "\u309a"

# --- fixed values: the vowel a prolonged sound mark stands for ---------------
PROLONGED_A = "あかさたなはまやらわァカサタナハマヤラワ"
PROLONGED_I = "いきしちにひみりィキシチニヒミリ"
PROLONGED_E = "えけせてねへめれェケセテネヘメレ"

EMPHATIC = "っッー～"

# --- fixed values: pre-reform orthography ------------------------------------
ORTHO_FROM = "ゐゑヰヱぢづヂヅつツやゆよヤユヨ"
ORTHO_TO = "いえイエじずジズっッゃゅょャュョ"
ORTHO_WA_ROW = "ゐゑヰヱ"
ORTHO_DA_ROW = "ぢづヂヅ"
ORTHO_SMALL_TSU = "つツ"
ORTHO_SMALL_YA = "やゆよヤユヨ"
ORTHO_DA_BLOCKED_AFTER = "つちツチ"
ORTHO_TSU_BEFORE = "たちつてとさしすせそぱぴぷぺぽタチツテトサシスセソパピプペポ"
ORTHO_YA_AFTER = "きしちにひみりぎじびぴキシチニヒミリギジビピ"

# --- fixed values: historical sound changes ----------------------------------
SOUND_HA_FROM = "はひふへ"
SOUND_HA_TO = "わいうえ"
SOUND_FU_PARTICLES = "はがのにをともやかぞなよねだでどばへこそしかまでより"
SOUND_HI_BEFORE = "てつな"
SOUND_HE_BEFORE = "したてばどきけるれりま"
SOUND_HA_BEFORE = "ずぬむば"
SOUND_AU = """
か こ
が ご
さ そ
ざ ぞ
た と
だ ど
な の
は ほ
ば ぼ
ぱ ぽ
ゃ ょ
や よ
ら ろ
わ お
"""
SOUND_EU = """
え よ
け きょ
げ ぎょ
せ しょ
ぜ じょ
て ちょ
で じょ
ね にょ
へ ひょ
べ びょ
ぺ ぴょ
め みょ
れ りょ
"""

# --- fixed values: vertical punctuation --------------------------------------
VERTICAL_FROM = "?\u2026\u2025"
VERTICAL_TO = "\uff1f\ufe19\ufe30"
PRESENTATION_FROM = (
    ",\uff0c\u3001\u3002\uff0e:\uff1a;\uff1b!\uff01?\uff1f\u3016\u3017\u2026"
    "\u2025\u2014\u30fc\u2013_(\uff08)\uff09{}\u3014\u3015\u3010\u3011\u300a\u300b"
    "\u3008\u3009\u300c\u300d\u300e\u300f[\uff3b]\uff3d"
)
PRESENTATION_TO = (
    "\ufe10\ufe10\ufe11\ufe12\ufe12\ufe13\ufe13\ufe14\ufe14\ufe15\ufe15\ufe16\ufe16\ufe17\ufe18\ufe19"
    "\ufe30\ufe31\ufe31\ufe32\ufe33\ufe35\ufe35\ufe36\ufe36\ufe37\ufe38\ufe39\ufe3a\ufe3b\ufe3c\ufe3d\ufe3e"
    "\ufe3f\ufe40\ufe41\ufe42\ufe43\ufe44\ufe47\ufe47\ufe48\ufe48"
)

# --- fixed values: readings and accents --------------------------------------
FUSING_KANA = "ぁぃぅぇぉゃゅょゎゕゖァィゥェォャュョヮヵヶ"
KANJI_CLASS = "\\u3005\\u303B\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF"
IDEOGRAPH_CLASS = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF"

# --- fixed values: size pairs, in pair-index order ---------------------------
SIZE_BIG = "あいうえおつやゆよわアイウエオツヤユヨワ"
SIZE_SMALL = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮ"
SIZE_BOUNDARY = "。\n"
SIZE_RADIUS = 5
SIZE_EPSILON = 0.01

# --- fixed values: recogniser classes ----------------------------------------
BLANK_CLASS = 0
FULL_SPACE_CLASS = 18708
SPACE_CLASS = 18709
BLANK_CHAR = "\u3000"
REPLACEMENT_CHAR = "\ufffd"
GAP_CHAR = "\u25cc"
TOP_K = 15

# --- fixed values: gap detection ---------------------------------------------
GAP_RATIO_VERTICAL = 1.6
GAP_RATIO_HORIZONTAL = 1.8
DEFAULT_STRIDE_PX = 8.0

# --- fixed values: gap candidates --------------------------------------------
FALLBACK_PUNCTUATION = "、。「」…ー"
FALLBACK_KANA = "はのをにと"
GAP_LIMIT = 15

# --- fixed values: n-gram model ----------------------------------------------
MAX_ORDER = 4
MIN_COUNT_TOP = 5
COUNT_CEILING = 65535
UNSEEN_LOG_PROB = -30.0

# --- fixed values: component similarity --------------------------------------
MIN_IDF_FRACTION = 0.7
MAX_COMPONENT_SUGGESTIONS = 15
MAX_VARIANT_SUGGESTIONS = 15

# --- fixed values: chunk stitching -------------------------------------------
STITCH_WINDOW = 10
STITCH_MAX_DIST = 30.0
STITCH_MIN_AGREEMENT = 0.4
STITCH_APPEND_GAP = 10.0

# --- fixed values: page geometry ---------------------------------------------
VERTICAL_ASPECT = 1.25
RUBY_SIZE = 0.3
RUBY_THIN = 0.75
RUBY_SHORT_H = 0.85
RUBY_WIDTH = 0.65
RUBY_WIDTH_H = 0.65
RUBY_GAP = 0.5
RUBY_OVERLAP = 0.5
RUBY_MAX_SIDE = 0.12
RUBY_MIN_BIG = 0.2
ENCLOSED_AREA = 0.6
ENCLOSED_ASPECT = 2.0
ENCLOSED_COUNT = 2
MIN_FRAME_SIDE = 10.0
VERTICAL_INSET = 0.05
MERGE_OVERLAP = 0.40
AXIS_TOL_DEG = 1.0
AXIS_QUANT_PX = 1.5
NAV_WEIGHT_LOCAL = 10.0
NAV_WEIGHT_FAR = 1.5
NAV_RADIUS = 0.05
NAV_K = 5

# --- fixed values: lookup ----------------------------------------------------
QUERY_WIDTH = 20
FULL_SPACE = "\u3000"
REDIRECT_HOPS = 3
REDIRECT_TARGETS = 3
REDIRECT_SAFE_CONTENT = ("references", "refGlosses", "redirect-glossary")
PLAIN_SKIPPED_KEYS = (
    "data", "href", "style", "path", "title", "tag", "type", "lang", "class", "code", "id",
)
LEGACY_BUILT_IN_ID = "kanjium-pitch-accents"
CATALOG_SCHEMA = 1


def pairs(block: str) -> list[tuple[str, str]]:
    """The ``from to`` rows of one of the multi-line tables above."""
    return [tuple(line.split(" ")) for line in block.split("\n") if line]


def measured_pairs() -> list[tuple[str, str]]:
    """The measured fold as ``(variant, canonical)`` rows."""
    return [(w[0], w[1]) for w in MEASURED_FOLD.split()]

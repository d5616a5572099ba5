"""SQL used to check the registered queries, and the helpers that build it."""

from __future__ import annotations

from kotonoha.functions import fixed as fx
from kotonoha.functions import text as tx
from kotonoha.plans import inputs


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(expr: str, rows) -> str:
    for a, b in rows:
        expr = f"replace({expr}, {quoted(a)}, {quoted(b)})"
    return expr


def translate(expr: str, source: str, target: str) -> str:
    return f"translate({expr}, {quoted(source)}, {quoted(target)})"


def kana(expr: str) -> str:
    return translate(expr, inputs.LETTERS, inputs.KANA)


# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    """``body`` after the named common tables it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if any(n.startswith("rec_") for n in order):
        recursive = True
    if not order:
        return body
    head = "with recursive " if recursive else "with "
    # each common table is computed once, however often it is read
    kind = lambda n: "as" if n.startswith("rec_") else "as materialized"
    return head + ",\n".join(f"{n} {kind(n)} ({CTES[n][1]})" for n in order) + "\n" + body


cte("words", "select doc_id, w from (select doc_id, unnest(string_split_regex(lower(text),'[^a-z]+')) w "
             "from documents) where w <> ''")
cte("word_counts", "select w, count(*) n from words group by w", "words")
cte("kana_surfaces", f"select {kana('w')} surface, n, w from word_counts", "word_counts")
cte("mixed_surfaces", f"select {translate('w', inputs.LETTERS, inputs.MIXED)} surface, n, w from word_counts",
    "word_counts")
cte("lines", "select conv_id page_id, turn line_idx, "
    + translate("lower(text)", inputs.LETTERS + " .,", inputs.KANA + "　。、")
    + " as text, turn % 2 = 1 is_vertical from conversations")
cte("entries", f"""select cast('0x' || substr(md5(w),1,15) as bigint) id, {kana('w')} kanji,
  {kana('substr(w,1,greatest(1,length(w)-1))')} reading,
  'n | ' || case when w like '%s' then 'v5' when w like '%e' then 'v1 vt' else 'adj' end rules,
  cast(n as integer) popularity, cast(length(w) % 5 as bigint) dictionary_id,
  case when length(w) % 7 = 0 then {kana('substr(w,1,2)')} end onyomi, cast(null as varchar) kunyomi,
  case when length(w) % 3 = 0 then cast(length(w) % 5 as varchar) end jlpt, w from word_counts""", "word_counts")
cte("meta", """select cast(r_regionkey as bigint) id, r_name "name", cast((r_regionkey*3) % 5 as integer) priority,
  r_regionkey <> 3 enabled, r_regionkey = 1 built_in,
  case when r_regionkey % 2 = 0 then 'cat-' || r_regionkey end catalog_id from region""")


# -- the key stages in SQL -----------------------------------------------------

def width_sql(e: str) -> str:
    return translate(replace_all(e, tx._HALF_PAIRS), tx._WIDTH_FROM, tx._WIDTH_TO)


def marks_sql(e: str) -> str:
    hira = "right(acc,1) between chr(12353) and chr(12438)"
    kata = "right(acc,1) between chr(12449) and chr(12534)"
    step = (
        f"acc || case when ch='ゝ' and {hira} then right(acc,1) "
        f"when ch='ゞ' and {hira} then {translate('right(acc,1)', fx.VOICELESS_HIRAGANA, fx.VOICED_HIRAGANA)} "
        f"when ch='ヽ' and {kata} then right(acc,1) "
        f"when ch='ヾ' and {kata} then {translate('right(acc,1)', fx.VOICELESS_KATAKANA, fx.VOICED_KATAKANA)} "
        "else ch end"
    )
    return f"list_reduce(list_prepend('', string_split({e}, '')), lambda acc, ch: {step})"


def fold_sql(e: str) -> str:
    return marks_sql(replace_all(translate(e, tx._FOLD_FROM, tx._FOLD_TO), tx._FOLD_MULTI))


def compose_sql(e: str) -> str:
    return replace_all(e, tx._COMBINING)


def hiragana_sql(e: str) -> str:
    step = (
        f"case when c='ー' and i>1 then case when instr({quoted(fx.PROLONGED_A)}, cs[i-1])>0 then 'あ' "
        f"when instr({quoted(fx.PROLONGED_I)}, cs[i-1])>0 then 'い' "
        f"when instr({quoted(fx.PROLONGED_E)}, cs[i-1])>0 then 'え' else 'う' end "
        f"else {translate('c', tx._KATAKANA, tx._HIRAGANA)} end"
    )
    return each_char(e, step)


def each_char(e: str, step: str) -> str:
    """``step`` over every character ``c`` at 1-based ``i`` of the list ``cs``."""
    return (
        f"list_transform([string_split({e}, '')], lambda cs: "
        f"array_to_string(list_transform(cs, lambda c, i: {step}), ''))[1]"
    )


def emphatic_sql(e: str) -> str:
    for c in fx.EMPHATIC:
        e = f"regexp_replace({e}, '{c}+', '{c}', 'g')"
    return e


def within(expr: str, chars: str) -> str:
    return f"instr({quoted(chars)}, {expr}) > 0"


def modern_sql(e: str) -> str:
    step = (
        f"case when {within('c', fx.ORTHO_WA_ROW)} "
        f"or ({within('c', fx.ORTHO_DA_ROW)} and (i=1 or not {within('cs[i-1]', fx.ORTHO_DA_BLOCKED_AFTER)})) "
        f"or ({within('c', fx.ORTHO_SMALL_TSU)} and i<len(cs) and {within('cs[i+1]', fx.ORTHO_TSU_BEFORE)}) "
        f"or ({within('c', fx.ORTHO_SMALL_YA)} and i>1 and {within('cs[i-1]', fx.ORTHO_YA_AFTER)}) "
        f"then {translate('c', fx.ORTHO_FROM, fx.ORTHO_TO)} else c end"
    )
    return each_char(e, step)


def ha_sql(e: str) -> str:
    kana_next = "(cs[i+1] between chr(12353) and chr(12438) or cs[i+1] between chr(12449) and chr(12534))"
    step = (
        "case when (c='ふ' and i>1 and cs[i-1]<>'う' and (i=len(cs) or not "
        f"{kana_next} or {within('cs[i+1]', fx.SOUND_FU_PARTICLES)})) "
        f"or (c='ひ' and i<len(cs) and {within('cs[i+1]', fx.SOUND_HI_BEFORE)}) "
        f"or (c='へ' and i<len(cs) and {within('cs[i+1]', fx.SOUND_HE_BEFORE)}) "
        f"or (c='は' and i>1 and i<len(cs) and {within('cs[i+1]', fx.SOUND_HA_BEFORE)}) "
        f"then {translate('c', fx.SOUND_HA_FROM, fx.SOUND_HA_TO)} else c end"
    )
    return each_char(e, step)


def sound_sql(e: str) -> str:
    return replace_all(ha_sql(e), tx._VOWEL_PAIRS)


def staged(source: str, surface: str = "surface") -> str:
    """Nested selects computing every key stage once per row of ``source``."""
    s = f"select *, {width_sql(surface)} width from ({source})"
    s = f"select *, {fold_sql('width')} folded from ({s})"
    s = f"select *, {compose_sql('folded')} norm from ({s})"
    s = f"select *, {modern_sql('norm')} modern from ({s})"
    s = f"select *, {ha_sql('modern')} ha from ({s})"
    s = f"select *, {replace_all('ha', tx._VOWEL_PAIRS)} sound from ({s})"
    return (
        f"select *, {hiragana_sql('norm')} k2, {emphatic_sql('norm')} k3, {hiragana_sql('modern')} k5, "
        f"{hiragana_sql('sound')} k7 from ({s})"
    )


def key_rows(source: str, surface: str = "surface") -> str:
    """``(surface, ord, stage, key)`` rows, first occurrence of a key kept."""
    items = (
        f"[{surface}, norm, k2, k3, modern, k5, sound, k7]"
    )
    stages = "['raw','normalised','hiragana','emphatic','modernised','modernised_hiragana','sound','sound_hiragana']"
    return (
        f"select {surface}, norm, modern, sound, row_number() over (partition by {surface} order by i) - 1 ord, stage, key from ("
        f"select {surface}, norm, modern, sound, i, {stages}[i] stage, ks[i] key from ("
        f"select {surface}, norm, modern, sound, {items} ks, unnest(range(1,9)) i from ({staged(source, surface)})) "
        "where list_position(ks, ks[i]) = i)"
    )

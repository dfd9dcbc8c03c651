"""Quality rules: a threshold table compiled into one Spark projection.

All measures are built-in expressions; no user function runs.  Texts are taken whole.

Defined cases: a null text is an empty text; an empty text has every measure 0, fails the
base rule and is not kept; rows are judged one by one, so repeated rows get equal answers and
an empty table gives an empty result; extra columns are ignored.  Three-word windows are
compared by 64-bit fingerprints within one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, text_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be this by at from or which a an not have he they his",
    "fr": "le la les de des du un une et est que qui en dans pour sur avec par pas au aux ce il elle ne se plus",
    "de": "der die das und ist in den von zu mit sich auf für nicht ein eine dem im des als auch es an er so dass",
    "es": "el la los las de del un una y es que en por para con su se no al lo como más o este ha sus",
}

# One row per rule: measure, lowest and highest value allowed (None: open).
RULES = (
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 0.15),
    ("shouts_per_word", None, 0.3),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.3),
)

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3

# Stages of the projection: later ones use the columns of earlier ones.
_SYMBOL_COUNT = " + ".join(f"(char_length({{t}}) - char_length(replace({{t}}, '{s}', '')))" for s in SYMBOLS)


def _stages(stop_words: tuple[str, ...]) -> list[dict[str, str]]:
    listed = ", ".join(f"'{word}'" for word in stop_words)
    return [
        {
            "_words": f"array_remove(split(_text, r'{WHITE_SPACE}'), '')",
            "_lines": "filter(split(_text, '\\n'), line -> line rlike r'[^\\x20\\x09-\\x0D]')",
            "n_symbols": f"CAST({_SYMBOL_COUNT.format(t='_text')} AS BIGINT)",
            "_shouts": "CAST(char_length(_text) - char_length(replace(_text, '!', '')) AS BIGINT)",
        },
        {
            "n_words": "CAST(size(_words) AS BIGINT)",
            "word_chars": "CAST(char_length(concat_ws('', _words)) AS BIGINT)",
            "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)",
            "_n_lines": "CAST(size(_lines) AS BIGINT)",
            "_stops": f"CAST(size(filter(_words, word -> lower(word) IN ({listed}))) AS BIGINT)",
            "_windows": f"""CASE WHEN size(_words) < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>)
                ELSE transform(sequence(0, size(_words) - {WINDOW}),
                    i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END""",
        },
        {
            # Only a text with a repeated window is sorted: equal windows then stand together.
            "_sorted": """CASE WHEN size(array_distinct(_windows)) < size(_windows)
                THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END""",
        },
        {
            "_starts": """CASE WHEN _sorted IS NOT NULL THEN sort_array(transform(
                filter(sequence(0, size(_sorted) - 1), k ->
                    (k > 0 AND _sorted[greatest(k - 1, 0)].h = _sorted[k].h) OR
                    (k < size(_sorted) - 1 AND _sorted[least(k + 1, size(_sorted) - 1)].h = _sorted[k].h)),
                k -> _sorted[k].i)) END""",
        },
        {
            "n_repeat_words": f"""CAST(CASE WHEN _starts IS NULL THEN 0 ELSE {WINDOW} + aggregate(
                sequence(1, size(_starts) - 1), 0,
                (sum, k) -> sum + least({WINDOW}, _starts[k] - _starts[k - 1])) END AS BIGINT)""",
        },
    ]


_MEASURES = {
    "mean_word_chars": "word_chars / nullif(n_words, 0)",
    "symbols_per_word": "n_symbols / nullif(n_words, 0)",
    "shouts_per_word": "_shouts / nullif(n_words, 0)",
    "stop_word_ratio": "_stops / nullif(n_words, 0)",
    "dup_line_ratio": "n_dup_lines / nullif(_n_lines, 0)",
    "repeat_word_ratio": "n_repeat_words / nullif(n_words, 0)",
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdict_sql(rules=RULES, measures=_MEASURES) -> str:
    """The rule table as one boolean SQL expression over the measures."""
    parts = []
    for name, low, high in rules:
        if low is not None:
            parts.append(f"({measures[name]}) >= {low!r}")
        if high is not None:
            parts.append(f"({measures[name]}) <= {high!r}")
    return " AND ".join(parts) or "true"


def base_failed_sql() -> str:
    return f"(n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words)"


def all_stop_words() -> tuple[str, ...]:
    return tuple(sorted({word for words in STOP_WORDS.values() for word in words.split()}))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, carry: bool = False) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` per row.

    ``carry`` keeps the whole input row in a struct column ``row`` beside the counts.
    """
    columns = [F.col(id_col), text_of(text_col).alias("_text")]
    if carry:
        columns = [F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), text_of(text_col).alias("_text")]
    frame = docs.select(*columns)
    for stage in _stages(all_stop_words()):
        frame = frame.selectExpr("*", *[f"{sql} AS {name}" for name, sql in stage.items()])
    kept = F.expr(f"NOT {base_failed_sql()} AND coalesce({verdict_sql(rules)}, false)")
    return frame.select("row" if carry else id_col, *COUNTS, F.expr(base_failed_sql()).alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with their columns unchanged."""
    judged = measure(docs, text_col=text_col, rules=rules, carry=True)
    # As generator output, so that the filter is not pushed below the stages and repeats them.
    judged = judged.select(F.inline(F.array(F.struct(F.col("row"), F.col("kept").alias("passed")))))
    return judged.where("passed").select("row.*")


def oracle() -> str:
    listed = ", ".join(f"'{word}'" for word in all_stop_words())
    measures = {name: sql.replace(" / ", " / 1.0 / ") for name, sql in _MEASURES.items()}
    symbols = "".join("\\" + s if s in "*$|" else s for s in SYMBOLS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines FROM d),
h AS (SELECT *, CASE WHEN len(ws) < 3 THEN [] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END AS g FROM w),
x AS (SELECT doc_id, unnest(g) AS gram, unnest(range(0, len(g))) AS i FROM h WHERE len(g) > len(list_distinct(g))),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM x) WHERE n > 1),
c AS (SELECT doc_id, sum(least(3, step)) AS n FROM (
        SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3) AS step FROM r) GROUP BY doc_id),
m AS (SELECT h.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[{symbols}]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS _shouts,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS _n_lines,
        len(list_filter(ws, lambda w: lower(w) IN ({listed})))::BIGINT AS _stops,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM h LEFT JOIN c ON c.doc_id = h.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base_failed_sql()} AS base_failed,
    NOT {base_failed_sql()} AND coalesce({verdict_sql(RULES, measures)}, false) AS kept FROM m
"""

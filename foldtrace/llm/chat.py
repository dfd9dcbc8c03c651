r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged
into one block by array functions, and blocks are concatenated:

    ### user:
    first text</turn>
    second text</turn>
    ### assistant:
    answer</turn>

Control strings inside texts are broken reversibly: between ``#`` and a following ``#`` (with
any backslashes between) one backslash is added, and likewise between ``<`` and ``/turn>``.
Escaped texts therefore never hold ``##`` or ``</turn>``.  Roles are URL-encoded.

The loss mask is an array of (start, length) spans, in code points, over the escaped
assistant texts.  ``read_back`` recovers roles, texts and the masked text from the output.

Defined cases: null text and null role read as empty; null turns sort first; turns with equal
numbers sort by role, then text; repeated rows are turns of their own; rows with a null
conversation id form one conversation; an empty table gives no conversation; extra columns are
ignored.  One conversation is one output row, so its turns meet in one task by contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"#(?=\\*#)", r"#\\"), r"<(?=\\*/turn>)", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"#\\(?=\\*#)", "#"), r"<\\(?=\\*/turn>)", "<")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conversation id, formatted, loss_spans array<struct<start,length>>) per conversation."""
    rows = turns.select(
        F.col(conv_col),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            escape(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
        ).alias("one"),
    )
    sorted_turns = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    # A block begins where the role differs from the turn before.
    begun = sorted_turns.withColumn(
        "begins", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[greatest(i - 1, 0)].role <> turns[i].role)")
    )
    merged = begun.withColumn(
        "blocks",
        F.expr(
            """transform(begins, (b, k) -> named_struct(
                'role', turns[b].role,
                'texts', transform(
                    slice(turns, b + 1, coalesce(try_element_at(begins, k + 2), size(turns)) - b), t -> t.text)))"""
        ),
    )
    headed = merged.withColumn(
        "blocks",
        F.transform(
            "blocks",
            lambda b: F.struct(
                b["role"].alias("role"), b["texts"].alias("texts"), F.concat(F.lit("### "), F.url_encode(b["role"]), F.lit(":\n")).alias("head")
            ),
        ),
    )
    body = F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], END), F.lit(END)))
    # Offsets: one pass over the blocks, then one over the texts of each trained block.
    lengths = F.expr(
        f"""flatten(transform(blocks, b -> transform(b.texts, (t, i) -> named_struct(
                'before', CASE WHEN i = 0 THEN char_length(b.head) ELSE 0 END,
                'length', char_length(t), 'after', {len(END)}, 'on', b.role = '{trained_role}'))))"""
    )
    spans = F.expr(
        """filter(aggregate(pieces, named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRUCT<start: INT, length: INT, trained: BOOLEAN>>)),
              (a, p) -> named_struct('at', a.at + p.before + p.length + p.after,
                  'spans', concat(a.spans, array(named_struct('start', a.at + p.before, 'length', p.length, 'trained', p.on))))).spans,
            s -> s.trained)"""
    )
    done = headed.withColumn("formatted", F.array_join(body, "")).withColumn("pieces", lengths).withColumn("spans", spans)
    return done.select(
        conv_col, "formatted", F.transform("spans", lambda s: F.struct(s["start"], s["length"])).alias("loss_spans")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role and text) and ``loss_text``, both read from the output."""
    blocks = F.split("formatted", "### ")  # escaped texts never hold this mark

    def turns_of(block: Column) -> Column:
        role = F.url_decode(F.substring_index(block, ":\n", 1))
        texts = F.split(F.substr(block, F.instr(block, F.lit(":\n")) + 2), END)
        return F.transform(
            F.slice(texts, F.lit(1), F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    turns = F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks) - 1), turns_of))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("*", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The digest columns of the contract, computed from the formatted text and the mask."""
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(formatted).select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: The extra conversation of the query: control strings inside both texts.
PROBE = (-7, "\\### Assistant: </turn> ok")


def oracle() -> str:
    conv, text = PROBE
    plain = r"replace(text, chr(92), '')"
    added = (
        # one backslash per # that is followed by # once backslashes are left out, and per </turn>
        f"(length({plain}) - length(replace({plain}, '#', ''))) - (length(regexp_replace({plain}, '#+', '#', 'g')) "
        f"- length(replace({plain}, '#', ''))) + len(regexp_extract_all(text, '<\\\\*/turn>'))"
    )
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {conv}, 0, 'user', '{text}' UNION ALL SELECT {conv}, 1, '{TRAINED_ROLE}', '{text}'),
e AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k, {added} AS added FROM c
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED_ROLE}'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
    sum(length(text) + added + {len(END)} + CASE WHEN before IS NULL OR before <> role
        THEN {len("### :") + 1} + length(url_encode(role)) ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

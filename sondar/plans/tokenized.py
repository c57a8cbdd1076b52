"""Queries of rendering, tokens and masks over dialogues and wildguard prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.operators import batching
from sondar.operators import masks as M
from sondar.operators import tokens as T
from sondar.functions.text import ROLE_ALIASES
from sondar.session import table


def chats(spark: SparkSession, sf_dir: str, template: T.Template = T.PLAIN) -> DataFrame:
    return T.rendered(table(spark, sf_dir, "dialogues"), template)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "wildguard_mix").where("prompt IS NOT NULL")
    single = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return T.rendered(w.select(F.col("record_id").alias("sample_id"), single.alias("messages")))


def _render(spark, sf):  # noqa: ANN001, ANN202
    return chats(spark, sf).select("sample_id", F.md5("text").alias("text"), F.length("text").alias("chars"))


def _render_gemma(spark, sf):  # noqa: ANN001, ANN202
    return chats(spark, sf, T.TEMPLATES["gemma"]).select("sample_id", F.md5("text").alias("text"))


def _render_llama(spark, sf):  # noqa: ANN001, ANN202
    return chats(spark, sf, T.TEMPLATES["llama"]).select("sample_id", F.md5("text").alias("text"))


def _counts(spark, sf):  # noqa: ANN001, ANN202
    return T.lossless_sums(chats(spark, sf)).where("n > 0")


def _roles(spark, sf):  # noqa: ANN001, ANN202
    t = T.tokenize(chats(spark, sf))
    return t.groupBy("sample_id", "msg_idx", F.col("role_id").cast("int").alias("role_id")).agg(F.count("*").alias("n"))


def _padded_roles(spark, sf):  # noqa: ANN001, ANN202
    t = T.tokenize(chats(spark, sf), padding=(4, 1))
    return t.groupBy("sample_id", F.col("role_id_padded").cast("int").alias("role_id")).agg(F.count("*").alias("n"))


def _windowed_roles(spark, sf):  # noqa: ANN001, ANN202
    """The dilation by windows, for tokens that come without it."""
    t = T.with_padded_roles(T.tokenize(prompts(spark, sf)), (4, 1))
    return t.groupBy("sample_id", F.col("role_id_padded").cast("int").alias("role_id")).agg(F.count("*").alias("n"))


def _rows(spark, sf):  # noqa: ANN001, ANN202
    """The token rows themselves, each text's in one hash."""
    t = T.tokenize(prompts(spark, sf)).select("sample_id", F.struct("pos", "token", "char_start", "char_end").alias("t"))
    rows = t.groupBy("sample_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    line = lambda x: F.concat_ws("|", x["pos"].cast("string"), x["token"], x["char_start"].cast("string"), x["char_end"].cast("string"))
    return rows.select("sample_id", F.md5(F.array_join(F.transform("t", line), ";")).alias("tokens"))


def _truncate(side: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = T.truncate(T.tokenize(chats(spark, sf_dir)), 64, side, None)
        return t.groupBy("sample_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.sum("char_start").alias("starts"))

    return run


def _gather(spark, sf):  # noqa: ANN001, ANN202
    s = prompts(spark, sf)
    return T.gather(T.tokenize(s), s, [3, 0, -1, 3]).groupBy("idx", "sample_id").agg(F.count("*").alias("n"))


def _pad_batches(spark, sf):  # noqa: ANN001, ANN202
    s = prompts(spark, sf)
    t = T.tokenize(s)
    counts = t.groupBy("sample_id").agg(F.count("*").alias("n"))
    lengths = s.select("sample_id").join(counts, "sample_id", "left").select("sample_id", F.coalesce("n", F.lit(0)).alias("n"))
    p = T.padded(t, s, batches=batching.sequence_batches(lengths, 32))
    return p.select("sample_id", F.size("ids").alias("length"), F.aggregate("attention", F.lit(0), lambda a, x: a + x).alias("real"))


def _range_join(spark, sf):  # noqa: ANN001, ANN202
    s = prompts(spark, sf)
    t = T.tokenize(s).alias("t")
    at = s.select("sample_id", F.floor(F.length("text") / 2).cast("int").alias("c")).alias("c")
    inside = (F.col("t.char_start") <= F.col("c.c")) & (F.col("c.c") < F.col("t.char_end"))
    return t.join(at, (F.col("t.sample_id") == F.col("c.sample_id")) & inside).select("t.sample_id", "c", "pos")


def _mask(source, build):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = source(spark, sf_dir)
        t = T.tokenize(s, padding=(4, 1), places=True) if source is chats else T.tokenize(s)
        m = M.apply(t, build(), s)
        chosen = m.where("det").groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))
        return chosen

    return run


MASKS = {
    "mask_all": (chats, M.all, "true"),
    "mask_role_padded": (chats, lambda: M.assistant(), "padded = 2"),
    "mask_role_exact": (chats, lambda: M.user(include_padding=False), "role_id = 1"),
    "mask_nth_message": (chats, lambda: M.nth_message(1), "msg_idx = 1"),
    "mask_nth_message_from_end": (chats, lambda: M.nth_message(-1), "msg_idx = last_msg"),
    "mask_first_n": (chats, lambda: M.first_n_tokens(3), "msg_idx >= 0 AND up <= 3"),
    "mask_last_n": (chats, lambda: M.last_n_tokens(2), "msg_idx >= 0 AND down <= 2"),
    "mask_last_token": (chats, lambda: M.last_token(), "msg_idx >= 0 AND down <= 1"),
    "mask_composed": (chats, lambda: (M.user(False) | M.nth_message(1)) & ~M.first_n_tokens(3), "(role_id = 1 OR msg_idx = 1) AND NOT (msg_idx >= 0 AND up <= 3)"),
}

TEXT_MASKS = {
    "mask_contains": (prompts, lambda: M.contains("an"), None),
    "mask_contains_case": (prompts, lambda: M.contains("The", case_sensitive=True), None),
    "mask_after": (prompts, lambda: M.after(". "), None),
    "mask_after_inclusive": (prompts, lambda: M.after(". ", inclusive=True), None),
    "mask_before": (prompts, lambda: M.before(". "), None),
    "mask_before_inclusive": (prompts, lambda: M.before(". ", inclusive=True), None),
    "mask_between": (prompts, lambda: M.between("the", "to"), None),
    "mask_between_inclusive": (prompts, lambda: M.between("the", "to", inclusive=True), None),
    "mask_regex": (prompts, lambda: M.regex(r"[0-9]+"), None),
    "mask_padding": (prompts, lambda: M.padding(M.contains("the"), 2, 1), None),
}

QUERIES = {
    "tokens_render_plain": _render,
    "tokens_render_gemma": _render_gemma,
    "tokens_render_llama": _render_llama,
    "tokens_counts": _counts,
    "tokens_window_dilation": _windowed_roles,
    "tokens_rows": _rows,
    "tokens_roles": _roles,
    "tokens_role_dilation": _padded_roles,
    "tokens_truncate_left": _truncate("left"),
    "tokens_truncate_right": _truncate("right"),
    "tokens_gather": _gather,
    "tokens_pad_batches": _pad_batches,
    "tokens_char_to_token": _range_join,
    **{name: _mask(source, build) for name, (source, build, _) in {**MASKS, **TEXT_MASKS}.items()},
}

_ROLE = "CASE lower(m.role) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLE_ALIASES.items()) + " ELSE lower(m.role) END"
_STRIP = "regexp_replace(coalesce(m.content, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"

_MERGED = f"""WITH u AS (SELECT sample_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM dialogues),
r AS (SELECT sample_id, i, {_ROLE} AS role, {_STRIP} AS content FROM u),
l AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY sample_id ORDER BY i) IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY sample_id ORDER BY i) - 1 AS k FROM l),
mm AS (SELECT sample_id, CAST(k AS INT) AS k, min(role) AS role, coalesce(string_agg(content, ' ' ORDER BY i) FILTER (WHERE content <> ''), '') AS content FROM g GROUP BY sample_id, k)
"""

# Leading system text is the user's, before two line ends; a dialogue that doesn't begin with the user gets an empty turn.
_MERGED_GEMMA = _MERGED.replace(
    "l AS (SELECT",
    """f AS (SELECT sample_id, i, CASE WHEN i = 1 AND role = 'system' THEN 'user' ELSE role END AS role, CASE WHEN i = 1 AND role = 'system' THEN content || chr(10) || chr(10) ELSE content END AS content FROM r),
l AS (SELECT""",
).replace("AS new FROM r)", "AS new FROM f)") + """, led AS (SELECT sample_id, k, role, content FROM mm UNION ALL SELECT sample_id, -1, 'user', '' FROM mm WHERE k = 0 AND role <> 'user')
"""

_PIECES = _MERGED + """, c AS (SELECT *, count(*) OVER (PARTITION BY sample_id) = 1 AND role = 'user' AS bare FROM mm),
p AS (SELECT sample_id, k, role, content, CASE WHEN bare THEN '' ELSE upper(role[1]) || role[2:] || ': ' END AS pre, CASE WHEN bare THEN '' ELSE chr(10) || chr(10) END AS post FROM c),
sp AS (SELECT *, CAST(sum(length(pre) + length(content) + length(post)) OVER (PARTITION BY sample_id ORDER BY k) - length(post) - length(content) AS BIGINT) AS s FROM p),
x AS (SELECT sample_id, regexp_replace(string_agg(pre || content || post, '' ORDER BY k), '[\\s]+$', '') AS text FROM p GROUP BY sample_id)
"""

_TOKEN = "'[ \\t\\n\\f\\r]+|[A-Za-z0-9_]+|[^ \\t\\n\\f\\rA-Za-z0-9_]+'"
_SPLIT = f"""a AS (SELECT sample_id, unnest(regexp_extract_all(text, {_TOKEN})) AS token, generate_subscripts(regexp_extract_all(text, {_TOKEN}), 1) - 1 AS pos FROM x),
t AS (SELECT sample_id, pos, token, CAST(sum(length(token)) OVER (PARTITION BY sample_id ORDER BY pos) - length(token) AS BIGINT) AS char_start,
 CAST(sum(length(token)) OVER (PARTITION BY sample_id ORDER BY pos) AS BIGINT) AS char_end FROM a)
"""
_TOKENS = _PIECES + ", " + _SPLIT
_ROLED = _TOKENS + """, tr AS (SELECT t.*, coalesce(min(sp.k), -1) AS msg_idx,
 coalesce(arg_min(CASE sp.role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE -1 END, sp.k), -1) AS role_id
 FROM t LEFT JOIN sp ON t.sample_id = sp.sample_id AND sp.s < t.char_end AND sp.s + length(sp.content) > t.char_start AND length(sp.content) > 0 GROUP BY ALL)
"""
_FRAME = "OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 4 FOLLOWING)"
_PADDED = f"""CASE WHEN max(CAST(role_id = 2 AS INT)) {_FRAME} = 1 THEN 2 WHEN max(CAST(role_id = 1 AS INT)) {_FRAME} = 1 THEN 1
 WHEN max(CAST(role_id = 0 AS INT)) {_FRAME} = 1 THEN 0 ELSE role_id END"""
_MASKED = _ROLED + f""", w AS (SELECT *, {_PADDED} AS padded, max(msg_idx) OVER (PARTITION BY sample_id) AS last_msg,
 row_number() OVER (PARTITION BY sample_id, msg_idx ORDER BY pos) AS up, row_number() OVER (PARTITION BY sample_id, msg_idx ORDER BY pos DESC) AS down FROM tr)
"""
_SUMS = "SELECT sample_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM {} WHERE {} GROUP BY sample_id"

_PROMPTS = f"WITH x AS (SELECT record_id AS sample_id, regexp_replace(prompt, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS text FROM wildguard_mix WHERE prompt IS NOT NULL), {_SPLIT}"


def _occurrences(needle: str, text: str = "text", overlapping: bool = True) -> str:
    """(sample_id, s, e): places of a literal."""
    return f"SELECT sample_id, i - 1 AS s, i - 1 + {len(needle)} AS e FROM (SELECT sample_id, text, unnest(range(1, length(text) + 1)) AS i FROM x) WHERE substr({text}, i, {len(needle)}) = '{needle}'"


def _touching(needle: str, text: str = "text") -> str:
    return _PROMPTS + f", o AS ({_occurrences(needle, text)}), h AS (SELECT DISTINCT t.sample_id, pos FROM t JOIN o ON t.sample_id = o.sample_id AND char_start < e AND char_end > s) " + _SUMS.format("h", "true")


def _from(offset: int) -> str:
    return (
        _PROMPTS
        + f", f AS (SELECT sample_id, strpos(text, '. ') - 1 AS c0 FROM x WHERE strpos(text, '. ') > 0), k AS (SELECT t.sample_id, pos AS k FROM t JOIN f USING (sample_id) WHERE char_start <= c0 + {offset} AND c0 + {offset} < char_end), h AS (SELECT t.sample_id, pos FROM t JOIN k USING (sample_id) WHERE pos >= k) "
        + _SUMS.format("h", "true")
    )


def _until(offset: int) -> str:
    return (
        _PROMPTS
        + f", f AS (SELECT sample_id, strpos(text, '. ') - 1 AS c0 FROM x WHERE strpos(text, '. ') > 0), k AS (SELECT t.sample_id, pos AS k FROM t JOIN f USING (sample_id) WHERE char_start <= c0 + {offset} AND c0 + {offset} < char_end), h AS (SELECT t.sample_id, pos FROM t JOIN k USING (sample_id) WHERE pos <= k) "
        + _SUMS.format("h", "true")
    )


def _between(inclusive: bool) -> str:
    a = "ta.pos" if inclusive else "tb.pos + 1"
    b = "tb.pos" if inclusive else "ta.pos - 1"
    at = "JOIN t ta ON ta.sample_id = o.sample_id AND ta.char_start <= o.s AND o.s < ta.char_end JOIN t tb ON tb.sample_id = o.sample_id AND tb.char_start <= o.e - 1 AND o.e - 1 < tb.char_end"
    bound = "" if inclusive else " WHERE tb.pos + 1 <= (SELECT max(pos) FROM t WHERE t.sample_id = o.sample_id)"
    return (
        _PROMPTS
        + f", s0 AS ({_occurrences('the')}), e0 AS ({_occurrences('to')}), st AS (SELECT o.sample_id, {a} AS a FROM s0 o {at}{bound}), en AS (SELECT o.sample_id, {b} AS b FROM e0 o {at}),"
        + " pr AS (SELECT st.sample_id, a, min(b) AS b FROM st JOIN en ON st.sample_id = en.sample_id AND b > a GROUP BY ALL), h AS (SELECT DISTINCT t.sample_id, pos FROM t JOIN pr ON t.sample_id = pr.sample_id AND pos BETWEEN a AND b) "
        + _SUMS.format("h", "true")
    )


ORACLES = {
    "tokens_render_plain": _PIECES + "SELECT sample_id, md5(text) AS text, length(text) AS chars FROM x",
    "tokens_render_llama": _MERGED
    + "SELECT sample_id, md5('<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || content || '<|eot_id|>', '' ORDER BY k)) AS text FROM mm GROUP BY sample_id",
    "tokens_render_gemma": _MERGED_GEMMA
    + "SELECT sample_id, md5('<bos>' || string_agg('<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10) || content || '<end_of_turn>' || chr(10), '' ORDER BY k)) AS text FROM led GROUP BY sample_id",
    "tokens_window_dilation": _PROMPTS + ", w AS (SELECT t.sample_id, 1 AS role_id FROM t) SELECT sample_id, role_id, count(*) AS n FROM w GROUP BY ALL",
    "tokens_rows": _PROMPTS
    + "SELECT sample_id, md5(string_agg(pos || '|' || token || '|' || char_start || '|' || char_end, ';' ORDER BY pos)) AS tokens FROM t GROUP BY sample_id",
    "tokens_counts": _TOKENS + "SELECT sample_id, count(*) AS n, max(char_end) AS chars, CAST(sum(char_start) AS BIGINT) AS starts FROM t GROUP BY sample_id",
    "tokens_roles": _ROLED + "SELECT sample_id, msg_idx, role_id, count(*) AS n FROM tr GROUP BY ALL",
    "tokens_role_dilation": _MASKED + "SELECT sample_id, padded AS role_id, count(*) AS n FROM w GROUP BY ALL",
    "tokens_truncate_left": _TOKENS
    + ", cc AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM t) SELECT sample_id, count(*) AS n, count(*) - 1 AS last, CAST(sum(char_start) AS BIGINT) AS starts FROM cc WHERE pos >= n - 64 GROUP BY sample_id",
    "tokens_truncate_right": _TOKENS + "SELECT sample_id, count(*) AS n, count(*) - 1 AS last, CAST(sum(char_start) AS BIGINT) AS starts FROM t WHERE pos < 64 GROUP BY sample_id",
    "tokens_gather": _PROMPTS
    + """, o AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS p, count(*) OVER () AS n FROM x), w(idx, i) AS (VALUES (0, 3), (1, 0), (2, -1), (3, 3)),
q AS (SELECT CAST(idx AS BIGINT) AS idx, sample_id FROM w JOIN o ON p = CASE WHEN i < 0 THEN n + i ELSE i END) SELECT idx, sample_id, count(*) AS n FROM q JOIN t USING (sample_id) GROUP BY ALL""",
    "tokens_pad_batches": _PROMPTS
    + """, c AS (SELECT x.sample_id, count(t.pos) AS real FROM x LEFT JOIN t USING (sample_id) GROUP BY 1),
b AS (SELECT *, (row_number() OVER (ORDER BY real DESC, sample_id) - 1) // 32 AS batch FROM c) SELECT sample_id, max(real) OVER (PARTITION BY batch) AS length, real FROM b""",
    "tokens_char_to_token": _PROMPTS
    + ", c AS (SELECT sample_id, CAST(floor(length(text) / 2) AS BIGINT) AS c FROM x) SELECT t.sample_id, c, pos FROM t JOIN c USING (sample_id) WHERE char_start <= c AND c < char_end",
    **{name: _MASKED + _SUMS.format("w", condition) for name, (_, _, condition) in MASKS.items()},
    "mask_contains": _touching("an", "lower(text)"),
    "mask_contains_case": _touching("The"),
    "mask_after": _from(2),
    "mask_after_inclusive": _from(0),
    "mask_before": _until(-1),
    "mask_before_inclusive": _until(1),
    "mask_between": _between(False),
    "mask_between_inclusive": _between(True),
    "mask_regex": _PROMPTS
    + ", o AS (SELECT sample_id, i - 1 AS s, i AS e FROM (SELECT sample_id, text, unnest(range(1, length(text) + 1)) AS i FROM x) WHERE regexp_matches(substr(text, i, 1), '[0-9]')), h AS (SELECT DISTINCT t.sample_id, pos FROM t JOIN o ON t.sample_id = o.sample_id AND char_start < e AND char_end > s) "
    + _SUMS.format("h", "true"),
    "mask_padding": _PROMPTS
    + f", o AS ({_occurrences('the', 'lower(text)')}), b AS (SELECT DISTINCT t.sample_id, pos FROM t JOIN o ON t.sample_id = o.sample_id AND char_start < e AND char_end > s), h AS (SELECT DISTINCT t.sample_id, t.pos FROM t JOIN b ON t.sample_id = b.sample_id AND t.pos BETWEEN b.pos - 2 AND b.pos + 1) "
    + _SUMS.format("h", "true"),
}

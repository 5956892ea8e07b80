"""The registered queries of the training-data operators, one a component, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import op1_toxicity, op2_token_files, op3_decontam, op4_chat, op5_quality, op6_html, op7_word_table, op8_warc, op9_simhash, op10_suffix_dedup, op11_ball_tree, op12_exponion, op13_string_kernel


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op1_toxicity.scored(docs, op1_toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_token_files_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_token_files.token_digest(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_decontam.held_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _held_sql(items: str) -> str:
    """Pairs of documents and items(item_id, text): windows of as many words as items have, five at most."""
    return f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM {items} WHERE item_id IS NOT NULL), k AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda p: array_to_string(w[p:p + least(len(w), 5) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
t AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s FROM t, k),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
h AS (SELECT d.doc_id, b.item_id, count(*) AS n_held FROM d JOIN b ON d.s = b.s GROUP BY ALL)
SELECT doc_id, h.item_id, n_shingles, n_held, round(n_held / n_shingles, 6) AS containment
FROM h JOIN n ON n.item_id = h.item_id WHERE round(n_held / n_shingles, 9) >= 0.8
"""


OP3_SQL = _held_sql("benchmark")


def short_items_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two to six words, the front of the benchmark's, inside of longer documents."""
    words = op3_decontam.words_of(F.col("text"))
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 5 + 2).cast("int")), " ").alias("text"))
    return op3_decontam.held_items(_table(spark, sf_dir, "documents"), items).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


SHORT_SQL = _held_sql(f"(SELECT item_id, array_to_string({_WORDS}[1:item_id % 5 + 2], ' ') AS text FROM benchmark)")


#: The tool of the exchanges below.
TELL = {"tell": {"type": "object", "required": ["n_chars"], "properties": {"n_chars": {"type": "integer", "maximum": 1000}}, "additionalProperties": False}}


def tool_exchanges(conversations: DataFrame) -> DataFrame:
    """The table's messages, with whole texts as contents, as exchanges with a tool, since they hold no calls of their own.

    An assistant's turn calls the tool with the length of its text; a user's turn but the first answers the turn before it, if
    that has called. Identifiers recur in a conversation. Messages without a turn, and of other roles, stay as they are.
    """
    t = F.col("turn")
    name = lambda turn: F.concat(F.lit("k"), (turn % 3).cast("string"))
    tell = F.struct(name(t).alias("id"), F.lit("tell").alias("name"), F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n_chars")).alias("arguments"))
    call = F.to_json(F.struct(F.col("text").alias("content"), F.array(tell).alias("tool_calls")))
    result = F.to_json(F.struct(name(t - 1).alias("tool_call_id"), F.col("text").alias("content")))
    calls, answers = (F.col("role") == "assistant") & t.isNotNull(), (F.col("role") == "user") & (t > 0)
    return conversations.select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), F.when(calls, call).when(answers, result).otherwise(F.col("text")).alias("text"))


def op4_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_chat.formatted(tool_exchanges(_table(spark, sf_dir, "conversations")), TELL).withColumnRenamed("conv", "conv_id")


OP4_SQL = """
WITH u AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn > 0 THEN 'tool' ELSE role END AS role, text FROM conversations),
c AS (SELECT conv_id, turn, turn % 3 AS k, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS nth FROM u WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, (turn - 1) % 3 AS k, row_number() OVER (PARTITION BY conv_id, (turn - 1) % 3 ORDER BY turn) AS nth FROM u WHERE role = 'tool'),
l AS (SELECT c.conv_id, c.turn AS call_turn, r.turn AS result_turn FROM c JOIN r ON c.conv_id = r.conv_id AND c.k = r.k AND c.nth = r.nth),
j AS (SELECT u.*, a.result_turn, b.call_turn FROM u LEFT JOIN l AS a ON u.role = 'assistant' AND a.conv_id = u.conv_id AND a.call_turn = u.turn
      LEFT JOIN l AS b ON u.role = 'tool' AND b.conv_id = u.conv_id AND b.result_turn = u.turn)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, CAST(CASE WHEN call_turn IS NULL THEN turn ELSE greatest(turn, call_turn) END AS BIGINT) AS order_turn, CAST(call_turn IS NOT NULL AS INTEGER) AS order_rank,
  CAST(role = 'assistant' AS BIGINT) AS n_calls, CAST(result_turn IS NOT NULL AS BIGINT) + CAST(call_turn IS NOT NULL AS BIGINT) AS n_linked,
  CAST(role IN ('assistant', 'tool') AND result_turn IS NULL AND call_turn IS NULL AS BIGINT) AS n_orphans, CAST(role = 'assistant' AND length(text) > 1000 AS BIGINT) AS n_invalid,
  CASE role WHEN 'assistant' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"assistant","tool_calls":[{"arguments":{"n_chars":' || length(text) || '},"errors":[' || CASE WHEN length(text) > 1000 THEN '"$.n_chars: maximum 1000"' ELSE '' END || '],"id":"k' || turn % 3
      || '","linked":' || CASE WHEN result_turn IS NULL THEN 'false' ELSE 'true' END || ',"name":"tell","result_turn":' || coalesce(CAST(result_turn AS VARCHAR), 'null') || '}]}'
    WHEN 'tool' THEN '{"call_turn":' || coalesce(CAST(call_turn AS VARCHAR), 'null') || ',"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"tool","tool_call_id":"k' || (turn - 1) % 3 || '","tool_name":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '"tell"' END || '}'
    ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' END AS message
FROM j
"""


#: Tools of the derived conversations below.
TOOLS = {
    "find": {"type": "object", "required": ["limit", "q"], "properties": {"limit": {"type": "integer", "minimum": 0}, "q": {"type": "string", "pattern": "[02468]$"}}, "additionalProperties": False},
    "sum": {"type": "object", "required": ["xs"], "properties": {"xs": {"type": "array", "items": {"type": "number"}}}},
}


def chat_tool_links_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results in the places of the table's turns: odd turns call two tools, later even ones answer the first of them.

    Identifiers recur in a conversation; the second call has its arguments as a string and is never answered.
    """
    c, t = F.col("conv_id"), F.col("turn")
    call = F.format_string('{"tool_calls": [{"id": "k%d", "name": "find", "arguments": {"q": "t%d", "limit": %d}}, {"id": "m%d", "name": "sum", "arguments": "{\\"xs\\": [1, %s]}"}]}', t % 3, c, t - 2, t, F.when(t % 4 == 1, "2").otherwise("null"))
    result = F.format_string('{"tool_call_id": "k%d", "content": "r%d"}', (t - 1) % 3, t)
    role = F.when(t % 2 == 1, "assistant").when(t > 0, "tool").otherwise("user")
    made = _table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), F.when(t % 2 == 1, call).when(t > 0, result).otherwise(F.lit("hello")).alias("text"))
    return op4_chat.formatted(made, TOOLS).withColumnRenamed("conv", "conv_id")


CHAT_SQL = """
WITH u AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'assistant' WHEN turn > 0 THEN 'tool' ELSE 'user' END AS role FROM conversations),
c AS (SELECT conv_id, turn, turn % 3 AS k, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS nth FROM u WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, (turn - 1) % 3 AS k, row_number() OVER (PARTITION BY conv_id, (turn - 1) % 3 ORDER BY turn) AS nth FROM u WHERE role = 'tool'),
l AS (SELECT c.conv_id, c.turn AS call_turn, r.turn AS result_turn FROM c JOIN r ON c.conv_id = r.conv_id AND c.k = r.k AND c.nth = r.nth),
j AS (SELECT u.*, a.result_turn, b.call_turn FROM u LEFT JOIN l AS a ON u.role = 'assistant' AND a.conv_id = u.conv_id AND a.call_turn = u.turn
      LEFT JOIN l AS b ON u.role = 'tool' AND b.conv_id = u.conv_id AND b.result_turn = u.turn),
e AS (SELECT *, list_filter([CASE WHEN turn < 2 THEN '"$.limit: minimum 0"' END, CASE WHEN conv_id % 2 = 1 THEN '"$.q: pattern"' END], lambda x: x IS NOT NULL) AS bad FROM j)
SELECT conv_id, turn, role, CASE WHEN call_turn IS NULL THEN turn ELSE greatest(turn, call_turn) END AS order_turn, CAST(call_turn IS NOT NULL AS INTEGER) AS order_rank,
  CASE WHEN role = 'assistant' THEN 2 ELSE 0 END AS n_calls, CAST(result_turn IS NOT NULL AS BIGINT) + CAST(call_turn IS NOT NULL AS BIGINT) AS n_linked,
  CASE role WHEN 'assistant' THEN 2 - CAST(result_turn IS NOT NULL AS BIGINT) WHEN 'tool' THEN 1 - CAST(call_turn IS NOT NULL AS BIGINT) ELSE 0 END AS n_orphans,
  CASE WHEN role = 'assistant' THEN CAST(len(bad) > 0 AS BIGINT) + CAST(turn % 4 <> 1 AS BIGINT) ELSE 0 END AS n_invalid,
  CASE role WHEN 'user' THEN '{"content":"hello","role":"user"}'
    WHEN 'tool' THEN '{"call_turn":' || coalesce(CAST(call_turn AS VARCHAR), 'null') || ',"content":"r' || CAST(turn AS VARCHAR) || '","role":"tool","tool_call_id":"k' || CAST((turn - 1) % 3 AS VARCHAR) || '","tool_name":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '"find"' END || '}'
    ELSE '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"limit":' || CAST(turn - 2 AS VARCHAR) || ',"q":"t' || CAST(conv_id AS VARCHAR) || '"},"errors":[' || array_to_string(bad, ',') || '],"id":"k' || CAST(turn % 3 AS VARCHAR)
      || '","linked":' || CASE WHEN result_turn IS NULL THEN 'false' ELSE 'true' END || ',"name":"find","result_turn":' || coalesce(CAST(result_turn AS VARCHAR), 'null') || '},{"arguments":{"xs":[1,' || CASE WHEN turn % 4 = 1 THEN '2' ELSE 'null' END
      || ']},"errors":[' || CASE WHEN turn % 4 = 1 THEN '' ELSE '"$.xs[1]: not of type number"' END || '],"id":"m' || CAST(turn AS VARCHAR) || '","linked":false,"name":"sum","result_turn":null}]}' END AS message
FROM e
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op5_quality.judged(docs, op5_quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_html.main_text(_table(spark, sf_dir, "pages"))


def neutral_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, article): the articles of pages between blocks of their host that no tag or name tells from them.

    Five hosts; the line above, the long box beside and the line below an article are a host's own, in plain blocks.
    """
    body = F.regexp_extract("html", r"(?s)<article>(.*?)(</article>|$)", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>|&[#A-Za-z0-9]+;|[<>&]", " "), r"[ \t\n\r]+", " "))
    site = (F.col("page_id") % 5).cast("string")
    half = F.floor(F.length(text) / 2).cast("int")
    parts = F.concat(F.lit("<p>Number "), F.col("page_id").cast("string"), F.lit("</p><p>"), F.substring(text, F.lit(1), half), F.lit("</p><p>"), F.substring(text, half + 1, F.length(text)), F.lit("</p>"))
    around = F.concat(F.lit("<html><body><div><p>All that is new on site "), site, F.lit(", every day and for everyone</p></div><div><div><p>"), F.repeat(F.concat(F.lit("Box of site "), site, F.lit(" with words that say nothing of its place. ")), 80), F.lit("</p></div><div>"), parts, F.lit("</div></div><div><p>Written by many people of site "), site, F.lit("</p></div></body></html>"))
    article = F.concat_ws(" ", F.concat(F.lit("Number "), F.col("page_id").cast("string")), F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://site"), site, F.lit("/"), F.col("page_id").cast("string")).alias("url"), around.alias("html"), article.alias("article"))


def html_main_text_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages whose layout only the host's template tells."""
    return op6_html.main_text(neutral_pages(spark, sf_dir).drop("article"))


DERIVED_HTML_SQL = r"""
WITH b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>|&[#A-Za-z0-9]+;|[<>&]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS x FROM pages),
t AS (SELECT page_id, 'Number ' || CAST(page_id AS VARCHAR) || ' ' || trim(regexp_replace(substr(x, 1, length(x) // 2) || ' ' || substr(x, length(x) // 2 + 1), ' +', ' ', 'g')) AS text FROM b)
SELECT page_id, 'http://site' || CAST(page_id % 5 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) AS url, text, length(text) AS n_chars FROM t
"""


def op7_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_word_table.bpe_digest(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_warc.warc_digest(_table(spark, sf_dir, "pages"), min_bytes=0)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_suffix_dedup.suffix_digest(_table(spark, sf_dir, "documents"))


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_ball_tree.clustered(_table(spark, sf_dir, "embeddings"))


def op12_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_exponion.compressed(_table(spark, sf_dir, "embeddings"))


def _whole_sql(scale: int) -> str:
    """v(vec_id, label, v): whole-number vectors of 64 finite components."""
    return f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


#: Floor of a sum over a count, in whole numbers.
_FLOOR = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _clusters_sql() -> str:
    near = "SELECT vec_id, v, c, d FROM (SELECT v.vec_id, v.v, z.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - z.z[i]) * (v.v[i] - z.z[i]))) AS d FROM v, {z} AS z) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"
    rounds = ""
    for r in range(3):
        rounds += f""", a{r} AS ({near.format(z=f"z{r}")}),
s{r} AS (SELECT c, list(m ORDER BY i) AS z FROM (SELECT c, i, {_FLOOR} AS m FROM (SELECT c, i, v[i] AS x FROM a{r}, range(1, 65) AS k(i)) GROUP BY c, i) GROUP BY c),
z{r + 1} AS (SELECT z{r}.c, coalesce(s{r}.z, z{r}.z) AS z FROM z{r} LEFT JOIN s{r} ON s{r}.c = z{r}.c)"""
    return f"""
WITH {_whole_sql(64)}, z0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS z FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h LIMIT 16)){rounds}, f AS ({near.format(z="z3")})
SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z3.z, ',')) AS centroid_sha256
FROM f JOIN z3 ON z3.c = f.c
"""


def _codes_sql() -> str:
    near = "SELECT id, p, x, e, d FROM (SELECT q.id, q.p, q.x, b.e, list_sum(list_transform(range(1, 5), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i]))) AS d FROM q JOIN {b} AS b ON b.p = q.p) QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY d, e) = 1"
    rounds = ""
    for r in range(2):
        rounds += f""", a{r} AS ({near.format(b=f"b{r}")}),
s{r} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, {_FLOOR} AS m FROM (SELECT p, e, i, x[i] AS x FROM a{r}, range(1, 5) AS k(i)) GROUP BY p, e, i) GROUP BY p, e),
b{r + 1} AS (SELECT b{r}.p, b{r}.e, coalesce(s{r}.x, b{r}.x) AS x FROM b{r} LEFT JOIN s{r} ON s{r}.p = b{r}.p AND s{r}.e = b{r}.e)"""
    return f"""
WITH {_whole_sql(256)}, q AS (SELECT vec_id AS id, p, v[4 * p + 1:4 * p + 4] AS x FROM v, range(0, 16) AS r(p)), b0 AS (SELECT p, n AS e, x FROM q JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM v) AS o ON o.vec_id = q.id WHERE n < 64){rounds}, f AS ({near.format(b="b2")}),
c AS (SELECT id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY id), h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v ON v.vec_id = c.id, h
"""


def op13_string_kernel_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op13_string_kernel.identified(docs, op13_string_kernel.fit(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity_scores, op2_token_files_crc, op3_benchmark_decontamination, op4_chat_tool_links, op5_quality_rules, op6_html_main_text, op7_word_table_bpe, op8_warc_archives, op9_simhash_near_dedup, op10_suffix_array_dedup, op11_ball_tree_clusters, op12_exponion_codes, op13_string_kernel_languages, chat_tool_links_derived, html_main_text_derived, short_items_derived, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL, "op4_chat_tool_links": OP4_SQL, "chat_tool_links_derived": CHAT_SQL, "html_main_text_derived": DERIVED_HTML_SQL, "short_items_derived": SHORT_SQL, "op11_ball_tree_clusters": _clusters_sql(), "op12_exponion_codes": _codes_sql()}

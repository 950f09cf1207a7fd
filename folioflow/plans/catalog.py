"""The registered queries over the given tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import chunking, elements, pii, text, vectors

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SIZE, CHILD = 1000, 200


def _register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return text.fenced(table(spark, d, "pages").select("page_id", "url", text.html_text(F.col("html")).alias("content")), "content")


def _doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of one text file each, with the standard signals."""
    from folioflow.operators.pages import finish

    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang")
    return finish(docs.select(path.alias("path"), F.lit(0).alias("page_index"), F.col("text").alias("content"), "source", "doc_id"))


# ---- SQL pieces ----------------------------------------------------------------------------------------------------

_BL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)" + "".join(f" || chr({ord(c)})" for c in text.BLANKS if ord(c) > 126)
_T = lambda c: f"trim({c}, {_BL})"


def _html_sql(c: str = "html") -> str:
    s = c
    for tag in ("script", "style", "noscript"):
        s = f"regexp_replace({s}, '(?is)<{tag}[^>]*>.*?</{tag}>', chr(10), 'g')"
    s = f"regexp_replace({s}, '(?i)<br\\s*/?>', chr(10), 'g')"
    s = f"regexp_replace({s}, '(?i)</(p|div|h[1-6]|li|tr)>', chr(10), 'g')"
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    for name, sign in (("nbsp", "' '"), ("amp", "'&'"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("#39", "chr(39)")):
        s = f"replace({s}, '&{name};', {sign})"
    return _T(s)


_CLASSES = (("ar", r"\x{0600}-\x{06FF}"), ("ru", r"\x{0400}-\x{04FF}"), ("zh", r"\x{4E00}-\x{9FFF}"), ("en", "A-Za-z"))


def _lang_sql(c: str) -> str:
    n = {k: f"length(regexp_replace(substr({c}, 1, 2000), '[^{x}]+', '', 'g'))" for k, x in _CLASSES}
    most = f"greatest({', '.join(n.values())})"
    return f"CASE WHEN {_T(c)} = '' THEN NULL WHEN {most} = 0 THEN 'unknown' " + " ".join(f"WHEN {v} = {most} THEN '{k}'" for k, v in n.items()) + " END"


def _conf_sql(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.1 WHEN {n} < 20 THEN 0.55 ELSE 0.9 END)::DOUBLE"


_HTML = f"h AS (SELECT page_id, url, {_html_sql()} AS content FROM pages)"
_PARAS = f"list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: {_T('p')}), lambda p: p <> '')"


def _pack_sql(parts: str, size: int) -> str:
    """The packer as a fold over {done, now}."""
    nn = "chr(10) || chr(10)"
    now = f"CASE WHEN a.now = '' OR {{f}} THEN p.now ELSE a.now || {nn} || p.now END"
    flush = f"a.now <> '' AND strlen(a.now) + strlen(p.now) + 2 > {size}"
    now = now.format(f=f"({flush})")
    done = f"CASE WHEN {flush} THEN list_append(a.done, a.now) ELSE a.done END"
    step = f"{{'done': CASE WHEN strlen({now}) >= {size} THEN list_append({done}, {now}) ELSE {done} END, 'now': CASE WHEN strlen({now}) >= {size} THEN '' ELSE {now} END}}"
    items = f"list_transform({parts}, lambda q: {{'done': []::VARCHAR[], 'now': q}})"
    fold = f"list_reduce({items}, lambda a, p: {step}, {{'done': []::VARCHAR[], 'now': ''}})"
    return f"(SELECT CASE WHEN f.now = '' THEN f.done ELSE list_append(f.done, f.now) END FROM (SELECT {fold} AS f))"


# ---- extraction and signals ----------------------------------------------------------------------------------------


@_register("html_strip", f"WITH {_HTML} SELECT page_id, content FROM h")
def html_strip(spark, d):
    return _pages(spark, d).select("page_id", "content")


@_register("csv_text", rf"SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(html, '\n$', ''), chr(10)), lambda x: rtrim(x, {_BL})), chr(10)) AS content FROM pages")
def csv_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.csv_text(F.col("html")).alias("content"))


@_register("xml_text", rf"SELECT page_id, regexp_replace({_T("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '[\s\x{{0B}}\x{{85}}\x{{A0}}]+', ' ', 'g') AS content FROM pages")
def xml_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.xml_text(F.col("html")).alias("content"))


@_register("html_quality", f"WITH {_HTML} SELECT page_id, strlen(content)::INTEGER AS n_bytes, strlen(content)::DOUBLE AS density, {_conf_sql('strlen(content)')} AS confidence, {_lang_sql('content')} AS language FROM h")
def html_quality(spark, d):
    n = F.octet_length("content")
    density = text.text_density(n)
    conf = text.confidence(n, density, F.lit(False), F.lit(False))
    return _pages(spark, d).select("page_id", n.alias("n_bytes"), density.cast("double").alias("density"), F.round(conf.cast("double"), 4).alias("confidence"), text.language_hint(F.col("content")).alias("language"))


@_register("language_hint", f"SELECT doc_id, {_lang_sql('text')} AS language FROM documents")
def language_hint(spark, d):
    return table(spark, d, "documents").select("doc_id", text.language_hint(F.col("text")).alias("language"))


@_register("confidence", f"SELECT doc_id, strlen(text)::DOUBLE AS density, {_conf_sql('strlen(text)')} AS confidence FROM documents")
def confidence(spark, d):
    n = F.octet_length("text")
    density = text.text_density(n)
    return table(spark, d, "documents").select("doc_id", density.cast("double").alias("density"), F.round(text.confidence(n, density, F.lit(False), F.lit(False)).cast("double"), 4).alias("confidence"))


_S4 = "substr(text, 1, 4000)"


@_register(
    "garbled_flag",
    rf"""SELECT doc_id, strlen(text) >= 20 AND (
  length(regexp_replace({_S4}, '[^\x{{FFFD}}\p{{Cc}}]+|[\n\t]+', '', 'g'))::DOUBLE / length({_S4}) > 0.08
  OR length(regexp_replace({_S4}, '[\p{{L}}\p{{N}}[:punct:]\s\x{{85}}\x{{A0}}]+', '', 'g'))::DOUBLE / length({_S4}) > 0.55) AS garbled FROM documents""",
)
def garbled_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", text.garbled(F.col("text")).alias("garbled"))


@_register(
    "ocr_gates",
    f"""WITH {_HTML}, n AS (SELECT page_id, strlen(content) AS n, strlen(content)::DOUBLE / 8.0 AS den FROM h)
SELECT page_id, (n < 80 OR den < 0.08) AND (page_id % 2 = 0 OR den < 0.15) AS hybrid, n < 5 OR (den < 0.06 AND n < 120) AS broken FROM n""",
)
def ocr_gates(spark, d):
    n = F.octet_length("content")
    den = text.text_density(n, 800, 800)
    return _pages(spark, d).select(
        "page_id",
        text.hybrid_ocr(n, den, F.col("page_id") % 2 == 0, F.lit(True)).alias("hybrid"),
        text.broken_page(n, den, F.lit(False), F.lit(False)).alias("broken"),
    )


@_register(
    "scanned_sniff",
    "WITH r AS (SELECT conv_id, strlen(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, avg(n) < 40.0 AS scanned FROM r WHERE k <= 5 GROUP BY conv_id",
)
def scanned_sniff(spark, d):
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    first = table(spark, d, "conversations").withColumn("k", k).where("k <= 5")
    return first.groupBy("conv_id").agg(text.looks_scanned(F.avg(F.octet_length("text"))).alias("scanned"))


# ---- personal data -------------------------------------------------------------------------------------------------


def _re2(kind: str) -> str:
    blind, p = next((b, p) for k, b, p in pii.KINDS if k == kind)
    return ("(?i)" if blind else "") + p


_KINDS = [k for k, _, _ in pii.KINDS]


def _steps_sql(repl: Callable[[str], str]) -> str:
    """Common table expressions t1, t2, ... of the text after each kind and of the hits."""
    parts = ["t0 AS (SELECT doc_id, text AS o, text AS t, 0 AS n, []::VARCHAR[] AS types FROM documents)"]
    for i, k in enumerate(_KINDS):
        p = _re2(k)
        m = f"regexp_matches(o, '{p}')"
        c = f"CASE WHEN {m} THEN len(regexp_extract_all(t, '{p}')) ELSE 0 END"
        parts.append(f"t{i + 1} AS (SELECT doc_id, o, CASE WHEN {m} THEN regexp_replace(t, '{p}', '{repl(k)}', 'g') ELSE t END AS t, n + {c} AS n, CASE WHEN {c} > 0 THEN list_append(types, '{k}') ELSE types END AS types FROM t{i})")
    return "WITH " + ",\n".join(parts)


@_register("pii_detect", "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{_re2(k)}') AS {k.lower()}" for k in _KINDS) + " FROM documents")
def pii_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", *[F.col("text").rlike(pii.pattern(k)).alias(k.lower()) for k in _KINDS])


def _sanitized(spark, d, mode):
    return pii.sanitize(table(spark, d, "documents"), "text", mode)


@_register("pii_redact", _steps_sql(lambda k: f"[{k}_REDACTED]") + f" SELECT doc_id, t AS text, n, array_to_string(types, ',') AS types FROM t{len(_KINDS)}")
def pii_redact(spark, d):
    return _sanitized(spark, d, "redact").select("doc_id", "pii.text", "pii.n", F.array_join("pii.types", ",").alias("types"))


@_register("pii_tag", _steps_sql(lambda k: f'<PII type="{k}">\\0</PII>') + f" SELECT doc_id, t AS text, n FROM t{len(_KINDS)}")
def pii_tag(spark, d):
    return _sanitized(spark, d, "tag").select("doc_id", "pii.text", "pii.n")


def _mask_sql(kind: str) -> str:
    if kind == "EMAIL":
        return "substr(h, 1, 1) || '***' || substr(h, instr(h, '@'))"
    if kind == "PHONE":
        digits = "regexp_replace(h, '[^0-9]', '', 'g')"
        return f"CASE WHEN length({digits}) >= 4 THEN '***-***-' || right({digits}, 4) ELSE '***' END"
    return "CASE WHEN strlen(h) <= 4 THEN '****' ELSE substr(h, 1, 2) || '****' END"


def _masked_sql() -> str:
    """The steps of masking: each hit is rewritten on its own and put back between what splitting leaves."""
    parts = ["t0 AS (SELECT doc_id, text AS o, text AS t, 0 AS n FROM documents)"]
    for i, k in enumerate(_KINDS):
        p = _re2(k)
        parts.append(f"m{i} AS (SELECT *, CASE WHEN regexp_matches(o, '{p}') THEN regexp_extract_all(t, '{p}') ELSE [] END AS hs FROM t{i})")
        parts.append(f"p{i} AS (SELECT *, CASE WHEN len(hs) > 0 THEN string_split_regex(t, '{p}') ELSE [t] END AS ps, list_transform(hs, lambda h: {_mask_sql(k)}) AS ms FROM m{i})")
        parts.append(f"t{i + 1} AS (SELECT doc_id, o, array_to_string(list_transform(range(1, len(ps) + 1), lambda j: ps[j] || coalesce(ms[j], '')), '') AS t, n + len(hs) AS n FROM p{i})")
    return "WITH " + ",\n".join(parts)


@_register("pii_mask", _masked_sql() + f" SELECT doc_id, t AS text, n::INTEGER AS n FROM t{len(_KINDS)}")
def pii_mask(spark, d):
    return _sanitized(spark, d, "mask").select("doc_id", "pii.text", "pii.n")


@_register("pii_summary", _steps_sql(lambda k: f"[{k}_REDACTED]") + f", s AS (SELECT lang, n FROM t{len(_KINDS)} JOIN documents USING (doc_id)) SELECT lang, count(*) AS pages, sum(n)::BIGINT AS hits, count(*) FILTER (n > 0) AS touched FROM s GROUP BY lang")
def pii_summary(spark, d):
    return _sanitized(spark, d, "redact").groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.sum("pii.n").alias("hits"), F.count_if(F.col("pii.n") > 0).alias("touched"))


# ---- chunks --------------------------------------------------------------------------------------------------------

@_register("paragraph_chunks", f"WITH {_HTML}, c AS (SELECT page_id, {_pack_sql(_PARAS, SIZE)} AS cs FROM h) SELECT page_id, (unnest(range(len(cs))))::INTEGER AS chunk_index, unnest(cs) AS chunk FROM c")
def paragraph_chunks(spark, d):
    """The paragraph packer on every page, whatever it holds."""
    return _pages(spark, d).select("page_id", F.posexplode(chunking.paragraph_chunks(F.col("content"), SIZE)).alias("chunk_index", "chunk"))


@_register(
    "paragraph_children",
    f"""WITH {_HTML}, c AS (SELECT page_id, {_pack_sql(_PARAS, SIZE)} AS cs FROM h),
x AS (SELECT page_id, (unnest(range(len(cs))))::INTEGER AS parent_index, unnest(cs) AS content FROM c),
y AS (SELECT page_id, parent_index, {_pack_sql(_PARAS, CHILD)} AS ks FROM x)
SELECT page_id, parent_index, unnest(ks) AS text FROM y""",
)
def paragraph_children(spark, d):
    """The packer on each of its own chunks."""
    rows = text.fenced(_pages(spark, d).withColumn("chunks", chunking.paragraph_chunks(F.col("content"), SIZE)), "chunks").select("page_id", F.posexplode("chunks").alias("parent_index", "chunk"))
    return rows.select("page_id", "parent_index", F.explode(chunking.paragraph_chunks(F.col("chunk"), CHILD)).alias("text"))


@_register("fast_chunks")
def fast_chunks(spark, d):
    """Every page: those with tables go to the structural splitter, the others to the packer. tests/test_table_pages.py has it in plain Python."""
    return chunking.fast_chunks(_pages(spark, d), "content", SIZE).select("page_id", F.posexplode("chunks").alias("chunk_index", "chunk"))


@_register("child_chunks")
def child_chunks(spark, d):
    """The chunks of every page split again, by structure or by paragraph as each holds a table mark or not."""
    kids = chunking.child_chunks(chunking.fast_chunks(_pages(spark, d), "content", SIZE), CHILD)
    return kids.select("page_id", F.explode("child_chunks").alias("c")).select("page_id", "c.parent_index", "c.text")


@_register("structural_chunks")
def structural_chunks(spark, d):
    got = table(spark, d, "documents").select("doc_id", chunking.structural(F.col("text"), SIZE).alias("chunks"))
    return got.select("doc_id", F.posexplode("chunks").alias("chunk_index", "chunk"))


@_register("structural_chunk_invariants", "SELECT doc_id, true AS fits, md5(regexp_replace(text, '\\s+', '', 'g')) AS letters FROM documents")
def structural_chunk_invariants(spark, d):
    """No chunk is too large and, white space aside, the chunks are the text."""
    got = table(spark, d, "documents").select("doc_id", chunking.structural(F.col("text"), SIZE).alias("chunks"))
    return got.select("doc_id", F.forall("chunks", lambda c: F.octet_length(c) <= SIZE).alias("fits"), F.md5(F.regexp_replace(F.array_join("chunks", ""), r"\s+", "")).alias("letters"))


_MARKED = "regexp_replace(regexp_replace(text, '([.!?\\n])([ \\t\\n\\f\\r])', '\\1' || chr(1) || '\\2', 'g'), '([.!?\\n])([ \\t\\n\\f\\r])', '\\1' || chr(1) || '\\2', 'g')"


@_register("sentences", f"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: {_T('x')}), lambda x: x <> '') AS ss FROM documents) SELECT doc_id, (unnest(range(len(ss))))::INTEGER AS i, unnest(ss) AS sentence FROM s")
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("i", "sentence"))


_SENTENCES = f"list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: {_T('x')}), lambda x: x <> '')"


@_register(
    "units",
    rf"""WITH {_HTML}, l0 AS (SELECT page_id, string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS ls FROM h),
l AS (SELECT page_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l0),
t AS (SELECT *, regexp_matches({_T('line')}, '^(\||### VLM Extracted:|\*\*Tableau Extrait)') AS is_table FROM l),
s AS (SELECT *, CASE WHEN lag(is_table) OVER (PARTITION BY page_id ORDER BY i) = is_table THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM s),
b AS (SELECT page_id, island, is_table, string_agg(line, chr(10) ORDER BY i) AS x FROM g GROUP BY page_id, island, is_table),
c AS (SELECT page_id, island, is_table, x, regexp_replace(x, '^\n+', '') AS text FROM b),
u AS (SELECT page_id, island, is_table, CASE WHEN is_table THEN [x] ELSE {_SENTENCES} END AS us FROM c),
v AS (SELECT page_id, island, is_table, unnest(us) AS unit, unnest(range(len(us))) AS j FROM u)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY island, j) - 1)::INTEGER AS unit_index, unit, is_table FROM v""",
)
def units(spark, d):
    return chunking.units(_pages(spark, d), "content", ["page_id"])


_SHARE = "least(greatest(round(n::DOUBLE * y.b / total)::BIGINT, 1), n - x.at)"


@_register(
    "doc_chunk_assign",
    f"""WITH c AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS ts, list(turn ORDER BY turn) AS us FROM conversations GROUP BY conv_id),
f AS (SELECT *, array_to_string(ts, chr(10) || chr(10)) AS content FROM c),
k AS (SELECT *, {_pack_sql(_PARAS, 600)} AS cs, list_transform(ts, lambda t: greatest(strlen(t), 1)) AS bs FROM f),
z AS (SELECT *, len(cs)::BIGINT AS n, list_sum(bs)::BIGINT AS total FROM k),
a AS (SELECT *, list_reduce(list_transform(bs, lambda b: {{'at': 0::BIGINT, 'ends': []::BIGINT[], 'b': b::BIGINT}}),
  lambda x, y: {{'at': x.at + {_SHARE}, 'ends': list_append(x.ends, x.at + {_SHARE}), 'b': y.b}}, {{'at': 0::BIGINT, 'ends': []::BIGINT[], 'b': 0::BIGINT}}) AS dealt FROM z),
p AS (SELECT conv_id, cs, n, ts, len(us) AS m, dealt, unnest(us) AS turn, unnest(range(1, len(us) + 1)) AS j FROM a),
q AS (SELECT conv_id, turn, ts[j] AS own, cs[coalesce(dealt.ends[j - 1], 0) + 1 : CASE WHEN j = m THEN n ELSE dealt.ends[j] END] AS got FROM p)
SELECT conv_id, turn, CASE WHEN len(got) > 0 THEN len(got) ELSE 1 END::INTEGER AS n_chunks, sha256(CASE WHEN len(got) > 0 THEN array_to_string(got, chr(10)) ELSE own END) AS chunks_sha256 FROM q""",
)
def doc_chunk_assign(spark, d):
    """Conversations as documents and turns as pages."""
    got = chunking.document_chunks(table(spark, d, "conversations"), 600, "conv_id", "turn", "text")
    return got.select("conv_id", "turn", F.size("chunks").alias("n_chunks"), F.sha2(F.array_join("chunks", "\n"), 256).alias("chunks_sha256"))


@_register("max_pages", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def max_pages(spark, d):
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").withColumn("k", k).where("k <= 3").select("conv_id", "turn", "text")


# ---- elements, vectors, reports, cache -----------------------------------------------------------------------------


@_register(
    "elements",
    rf"""WITH {_HTML}, p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(content, '\n\s*\n'), lambda x: {_T('x')}), lambda x: x <> '') AS ps FROM h),
e AS (SELECT page_id, (unnest(range(len(ps))))::INTEGER AS element_index, unnest(ps) AS text FROM p)
SELECT page_id, element_index, text, CASE WHEN starts_with(text, '|') AND contains(substr(text, 2), '|') THEN 'Table'
 WHEN regexp_matches(text, '^#{{1,6}}\s') OR (length(text) < 120 AND upper(text) = text AND lower(text) <> text) THEN 'Title'
 WHEN regexp_matches(text, '^([-*\x{{2022}}]|\d+\.)\s') THEN 'ListItem' WHEN length(text) < 80 AND NOT ends_with(text, '.') THEN 'Header' ELSE 'NarrativeText' END AS category FROM e""",
)
def elements_(spark, d):
    pages = _pages(spark, d).select(F.col("page_id").cast("string").alias("path"), F.col("page_id").alias("page_index"), "content", F.array().cast("array<string>").alias("warnings"))
    return elements.elements(pages).select(F.col("page_index").alias("page_id"), "element_index", "text", "category")


@_register("adjacent_cosine", "SELECT vec_id, round(coalesce(list_cosine_similarity(lag(embedding::DOUBLE[]) OVER w, embedding::DOUBLE[]), -2), 4) AS similarity FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def adjacent_cosine(spark, d):
    got = vectors.adjacent(table(spark, d, "embeddings"), "vec_id", "embedding", ["label"])
    return got.select("vec_id", F.round(F.coalesce("similarity", F.lit(-2.0)), 4).alias("similarity"))


@_register("semantic_chunks")
def semantic_chunks(spark, d):
    """Sentences with vectors from the hashing embedder, cut where neighbours differ."""
    from folioflow.sources.backends import HashingEmbedder, similarities

    docs = text.fenced(table(spark, d, "documents").select("doc_id", chunking.sentences(F.col("text")).alias("sentence")), "sentence")
    docs = text.fenced(docs.withColumn("sim", similarities(F.col("sentence"), HashingEmbedder(32), 256)), "sim")
    return docs.select("doc_id", F.posexplode(vectors.cut_chunks(F.arrays_zip("sentence", "sim"), SIZE)).alias("chunk_index", "chunk"))


@_register(
    "mean_pool",
    "WITH u AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM u GROUP BY label, i) SELECT label, i::INTEGER AS i, round(x, 5) AS x FROM m",
)
def mean_pool(spark, d):
    return vectors.mean_by(table(spark, d, "embeddings"), ["label"], "embedding").withColumn("x", F.round("x", 5))


_REPORT = f"""WITH p AS (SELECT source || '/' || doc_id || '.' || lang AS path, lang, strlen(text) AS n, {_conf_sql('strlen(text)')} AS c, {_T('text')} = '' AS blank FROM documents),
f AS (SELECT *, blank AND c < 0.2 AS failed FROM p), b AS (SELECT path, bool_and(NOT failed) AS ok FROM f GROUP BY path)
"""


@_register("ingest_report", _REPORT + "SELECT (SELECT count(*) FILTER (ok) FROM b) AS files_ok, (SELECT count(*) FILTER (NOT ok) FROM b) AS files_failed, count(*) AS pages_total, 0::BIGINT AS pages_ocr, round(avg(c), 4) AS avg_confidence, 0::BIGINT AS repair_count FROM f")
def ingest_report(spark, d):
    from folioflow.operators.report import ingest_report as build

    return build(_doc_pages(spark, d)).select("files_ok", "files_failed", "pages_total", "pages_ocr", F.round(F.col("avg_confidence").cast("double"), 4).alias("avg_confidence"), "repair_count")


@_register("report_by_extension", "SELECT lang AS extension, count(*) AS pages FROM documents GROUP BY lang")
def report_by_extension(spark, d):
    from folioflow.operators.report import ingest_report as build

    return build(_doc_pages(spark, d)).select(F.explode("by_extension").alias("extension", "pages"))


@_register("report_by_source", f"SELECT source, count(*) AS pages, sum(length(text))::BIGINT AS chars, round(avg({_conf_sql('strlen(text)')}), 4) AS avg_confidence FROM documents GROUP BY source")
def report_by_source(spark, d):
    return (
        _doc_pages(spark, d)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("content")).alias("chars"), F.round(F.avg(F.col("extraction_confidence").cast("double")), 4).alias("avg_confidence"))
    )


@_register("doctor", f"SELECT lang AS extension, count(*) AS files, count(*) FILTER (strlen(text) = 0) AS broken_files, count(*) FILTER (length({_T('text')}) < 5) AS sparse_pages FROM documents GROUP BY lang")
def doctor(spark, d):
    from folioflow.operators.report import doctor as build

    return build(_doc_pages(spark, d)).select("extension", "files", "broken_files", "sparse_pages")


@_register("label_signals", f"SELECT quality, toxic, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes, round(avg({_conf_sql('strlen(text)')}), 4) AS avg_confidence FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def label_signals(spark, d):
    n = F.octet_length("text")
    docs = table(spark, d, "documents").select("doc_id", n.alias("n"), text.confidence(n, text.text_density(n), F.lit(False), F.lit(False)).cast("double").alias("c"))
    return docs.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("bytes"), F.round(F.avg("c"), 4).alias("avg_confidence"))


def _cached(spark, d):
    from folioflow.operators.cache import with_key

    docs = with_key(table(spark, d, "documents"), "text", {"chunk_size": SIZE})
    return docs, docs.where(F.col("source") != "src0").select("cache_key").distinct()


_KEY = "sha256('chunk_size=1000' || chr(31) || text)"


@_register("cache_miss", f"WITH k AS (SELECT doc_id, source, {_KEY} AS cache_key FROM documents) SELECT doc_id, cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE source <> 'src0')")
def cache_miss(spark, d):
    docs, cache = _cached(spark, d)
    return docs.join(cache, "cache_key", "left_anti").select("doc_id", "cache_key")


@_register("cache_hit", f"WITH k AS (SELECT doc_id, source, {_KEY} AS cache_key FROM documents) SELECT doc_id, cache_key FROM k WHERE cache_key IN (SELECT cache_key FROM k WHERE source <> 'src0')")
def cache_hit(spark, d):
    docs, cache = _cached(spark, d)
    return docs.join(cache, "cache_key", "left_semi").select("doc_id", "cache_key")


@_register("json_lines", "SELECT event_id, array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || ': ' || (props::JSON ->> k)), ' | ') AS line FROM events")
def json_lines(spark, d):
    from folioflow.sources.native import ndjson_line

    return table(spark, d, "events").select("event_id", ndjson_line(F.col("props")).alias("line"))


def _exported(pages: DataFrame) -> DataFrame:
    from folioflow.operators.export import chunk_documents

    pages = pages.withColumns({"page_index": F.lit(0), "metadata": F.create_map().cast("map<string,string>"), "form_fields": F.create_map().cast("map<string,string>")})
    return chunk_documents(pages.withColumnRenamed("url", "path")).select("id", "text", F.col("metadata")["source"].alias("source"))


@_register("paragraph_documents", f"WITH {_HTML}, c AS (SELECT page_id, url, {_pack_sql(_PARAS, SIZE)} AS cs FROM h) SELECT url || '_p0_chunk_' || unnest(range(len(cs))) AS id, unnest(cs) AS text, url AS source FROM c")
def paragraph_documents(spark, d):
    return _exported(_pages(spark, d).withColumn("chunks", chunking.paragraph_chunks(F.col("content"), SIZE)))


@_register("export_chunks")
def export_chunks(spark, d):
    """The chunks of every page as documents."""
    return _exported(chunking.fast_chunks(_pages(spark, d), "content", SIZE))


@_register("fixed_layout")
def fixed_layout(spark, d):
    """Reading order of boxes made from line items: columns of boxes on pages of one order each."""
    from folioflow.operators.layout import reading_order

    li = table(spark, d, "lineitem")
    x = ((F.col("l_linenumber") - 1) % 3) * 200.0
    y = F.floor((F.col("l_linenumber") - 1) / 3) * 80.0
    boxes = li.select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") - 1).cast("int").alias("idx"), x.cast("float").alias("x0"), y.cast("float").alias("y0"), (x + 150).cast("float").alias("x1"), (y + 60).cast("float").alias("y1"))
    return reading_order(boxes, 600.0, 800.0, True).select("page_id", "idx", "reading_index")


_FIXED = """WITH c AS (SELECT l_orderkey AS page_id, (l_linenumber - 1)::INTEGER AS idx FROM lineitem)
SELECT page_id, idx, (row_number() OVER (PARTITION BY page_id ORDER BY idx % 3, idx // 3) - 1)::INTEGER AS reading_index FROM c"""
_SQL["fixed_layout"] = _FIXED


@_register("interval_merge", """WITH e AS (SELECT l_suppkey AS k, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::DOUBLE AS s, datediff('day', DATE '1990-01-01', l_shipdate::DATE)::DOUBLE + l_tax * 100 AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, i""")
def interval_merge(spark, d):
    from folioflow.operators.layout import merge_intervals

    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("double")
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), day("l_shipdate").alias("s"), (day("l_shipdate") + F.col("l_tax") * 100).alias("e"))
    return merge_intervals(li, ["k"], "s", "e")


def queries() -> dict[str, Query]:
    from folioflow.plans import catalog_files  # noqa: F401  # registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from folioflow.plans import catalog_files  # noqa: F401

    return dict(_SQL)

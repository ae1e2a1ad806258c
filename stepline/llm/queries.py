"""The queries of the numbered operators over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.llm import chat, decontam, divergence, langid, lines, maxscore, mixing, prefix_trie, quality, simhash, substrings, toxicity, warc
from stepline.plans.oracle import key, unit
from stepline.plans.registry import Query
from stepline.sources.tables import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


OP1_SQL = rf"""WITH w AS (SELECT doc_id, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4],' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-3)) AS i FROM w WHERE len(ws)>5)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n>1),
cov AS (SELECT doc_id, count(DISTINCT i+k) AS n FROM rep, range(0,5) r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(*)-count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws,''))::BIGINT AS word_chars,
  length(regexp_replace(t,'[^#*$%&|<>]+','','g'))::BIGINT AS n_symbols, coalesce(ln.dup,0)::BIGINT AS n_dup_lines,
  coalesce(cov.n,0)::BIGINT AS n_repeat_words, coalesce(ln.n,0) AS n_lines,
  length(regexp_replace(t,'[^A-Z]+','','g')) AS up, length(regexp_replace(t,'[^A-Za-z]+','','g')) AS letters
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words<{quality.MIN_WORDS} OR 100*n_repeat_words>{quality.MAX_REPEAT_PCT}*n_words) AS base_failed,
  NOT (n_words<{quality.MIN_WORDS} OR 100*n_repeat_words>{quality.MAX_REPEAT_PCT}*n_words OR 100*n_symbols>{quality.MAX_SYMBOLS_PCT}*n_words
    OR 100*n_dup_lines>{quality.MAX_DUP_LINES_PCT}*n_lines OR word_chars<{quality.MIN_WORD_CHARS}*n_words OR word_chars>{quality.MAX_WORD_CHARS}*n_words
    OR 100*up>{quality.MAX_CAPITALS_PCT}*letters) AS kept FROM f"""


@query("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures of every document; what they let through is judged by the cascade of the other rules."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    beyond = tuple(r for r in quality.RULES if r.name not in ("few_words", "repeats"))
    verdict = quality.cascade(quality.order_rules(docs, beyond), F.col("text"))
    n = F.col("n_words")
    failed = (n < quality.MIN_WORDS) | (100 * F.col("n_repeat_words") > quality.MAX_REPEAT_PCT * n)
    judged = quality.base_figures(docs).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict.isNull()))
    return judged.drop("text")


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document that holds a benchmark passage, with the longest one."""
    found = decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.lit(True).alias("contaminated"), "n_items", F.col("item").alias("item_id"), "from_token", "to_token", "equal_tokens")


def fold(id_col: str, modulus: int, remainder: int):
    """Whether the row is held out; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A score per document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(~fold("doc_id", 4, 2)))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_simhash_near_duplicates")
def op4_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def _op5_sql() -> str:
    t = chat.Template()
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    body = f"replace(text,{lit(t.escape)},{lit(t.escape * 2)})"
    for c in t.controls:
        body = f"replace({body},{lit(c)},{lit(c[0] + t.escape + c[1:])})"
    role = body.replace("replace(text,", "replace(role,")
    marks = len(t.start) + len(t.middle) + len(t.end)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role='{t.learn}'),0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role='{t.learn}'),'')) AS loss_sha256,
  sum({marks}+length({role})+length({body}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


@query("op5_chat_formatting", _op5_sql())
def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every conversation and of one full of control strings, read back from the formatted text."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    done = chat.format_records(chat.records_of(rows.unionByName(own)), "record")
    back = done.select("conv", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = """WITH p AS (SELECT page_id, coalesce(html,'') AS h FROM pages),
f AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, upper(sha1(h)) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0,32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x'||substr(x, ((i//4)*5+1)::INT, 5))::BIGINT >> (15-5*(i%4))::INT) & 31)+1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id=first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id<>first THEN first END AS refers_to FROM f"""


@query("op6_warc", OP6_SQL)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives with a dictionary in front and read back."""
    read = warc.round_trip(table(spark, folder, "pages"))
    return read.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """A language per document, learned from the documents outside the held-out fold."""
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(~fold("doc_id", 5, 0)))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))


OP8_SQL = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h, strlen(coalesce(text,'')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2*i+1, {2 * substrings.LENGTH})) AS s FROM (SELECT doc_id, h, unnest(range(0, n-{substrings.LENGTH - 1})) AS i FROM d WHERE n>={substrings.LENGTH})),
late AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i)>1),
run AS (SELECT doc_id, min(i) AS a, max(i)+{substrings.LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
  SELECT *, CASE WHEN i<=lag(i) OVER (PARTITION BY doc_id ORDER BY i)+{substrings.LENGTH} THEN 0 ELSE 1 END AS new FROM late)) GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a),0) AS x, a AS y FROM run
  UNION ALL SELECT r.doc_id, r.b, d.n FROM (SELECT doc_id, max(b) AS b FROM run GROUP BY doc_id) r JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, (2*x+1)::BIGINT, (2*(y-x))::BIGINT), '' ORDER BY x) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b-a)::BIGINT AS gone, count(*)::BIGINT AS spans FROM run GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone,0)::BIGINT AS n_removed, coalesce(spans,0)::BIGINT AS n_spans, sha256(unhex(coalesce(k,h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op8_suffix_dedup", OP8_SQL)
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document when bytes of strings that start earlier are removed."""
    out = substrings.remove_copies(table(spark, folder, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP9_SQL = f"""WITH RECURSIVE s AS (SELECT source, sum(coalesce(length(text),0))::DOUBLE AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS size, count(*) FILTER (WHERE size>0)::DOUBLE AS w FROM s),
r AS (SELECT source, CASE WHEN s.size>0 THEN 1.0::DOUBLE/t.w*t.size/s.size ELSE 0.0 END AS mean FROM s, t),
q AS (SELECT source, mean, greatest(1, ceil(mean/{mixing.MAX_MEAN}))::INT AS parts FROM r WHERE mean>0),
c AS (SELECT source, parts, mean/parts AS m, 0 AS k, exp(-(mean/parts)) AS p, exp(-(mean/parts)) AS c FROM q
  UNION ALL SELECT source, parts, m, k+1, p*m/(k+1), c+p*m/(k+1) FROM c WHERE k<ceil(m)+{mixing.SLACK}),
u AS (SELECT doc_id, source, parts, {unit(key(42, "doc_id", "j"))} AS u FROM (SELECT d.doc_id, d.source, q.parts, unnest(range(1, q.parts+1)) AS j FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source)),
n AS (SELECT u.doc_id, sum(least(x, ceil(q.mean/q.parts)+{mixing.SLACK}))::INT AS n FROM (SELECT u.doc_id, u.source, u.u, count(c.k) AS x FROM u LEFT JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.c<=u.u GROUP BY ALL) u
  JOIN q ON q.source IS NOT DISTINCT FROM u.source GROUP BY u.doc_id)
SELECT d.*, unnest(range(1, n.n+1))::INT AS copy FROM documents d JOIN n USING (doc_id)"""


@query("op9_source_mixing", OP9_SQL)
def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents repeated so that every source has the same share of characters, shuffled."""
    return mixing.mix(table(spark, folder, "documents"))


@query("op10_line_dedup")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the text that is left, and the number of its lines that went."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


OP11_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024*x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE)))=0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda z: z[1]*z[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id<>v.vec_id WHERE q.vec_id%100=0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)<=10"""


@query("op11_maxscore_search", OP11_SQL)
def op11_maxscore_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


OP12_SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang,'') AS lang, coalesce(source,'') AS source, coalesce(text,'') AS text FROM documents),
w AS (SELECT doc_id, lang, source, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS x FROM d)),
k AS (SELECT lang, t, count(*) AS ln FROM w GROUP BY lang, t HAVING count(DISTINCT doc_id)>={divergence.MIN_DOCS}),
c AS (SELECT lang, source, t, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM k GROUP BY lang),
m AS (SELECT g.lang, g.source, k.t, k.ln, l.v, l.total, coalesce(c.n,0) AS n FROM g JOIN k ON k.lang=g.lang JOIN l ON l.lang=g.lang LEFT JOIN c ON c.lang=g.lang AND c.source=g.source AND c.t=k.t),
s AS (SELECT lang, source, sum(n) AS own FROM m GROUP BY lang, source),
p AS (SELECT m.lang, m.source, t, n, 1+(1000000000::HUGEINT*(n+2)//(s.own+2*v)::HUGEINT) AS p, 1+(1000000000::HUGEINT*(ln+2)//(total+2*v)::HUGEINT) AS q FROM m JOIN s ON s.lang=m.lang AND s.source=m.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p-b.p)*(a.p-b.p)//(a.p+b.p)) AS value FROM p AS a JOIN p AS b ON a.lang=b.lang AND a.t=b.t AND a.source<>b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value,0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang=b.lang AND a.source<>b.source
  LEFT JOIN pairs ON pairs.lang=a.lang AND pairs.source=a.source AND pairs.item=b.source),
terms AS (SELECT lang, source, t AS item, ((p-q)*(p-q)//(p+q))::BIGINT AS value FROM p WHERE n>0 AND p>q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank<={divergence.TOP_TERMS}"""


@query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that each uses more than its language."""
    return divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"))


def _op13_sql() -> str:
    crc = [i for i in range(256)]
    for _ in range(8):
        crc = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in crc]
    return f"""WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), md5(coalesce(text,''))) AS i,
  coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations WHERE conv_id IS NOT NULL),
tab AS (SELECT {crc} AS b),
x AS (SELECT DISTINCT c, c::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM t
  UNION ALL SELECT c, s, k+1, xor(v >> 8, b[(xor(v & 255, ascii(substr(s, k+1, 1))::BIGINT) + 1)::BIGINT]::BIGINT) FROM x, tab WHERE k<length(s)),
h AS (SELECT c, c-c%100 AS base, xor(v, 4294967295::BIGINT)%6 AS h FROM x WHERE k=length(s)),
r AS (SELECT h.c, t.i, t.role, t.text FROM h JOIN t ON t.c=h.base AND t.i<=h.h UNION ALL SELECT h.c, t.i, t.role, t.text FROM h JOIN t ON t.c=h.c AND t.i>h.h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, sha256(length(role)||':'||role||text) AS e, length(text) AS size FROM r),
z AS (SELECT c, 0 AS d, '' AS e, 0 AS size FROM h UNION ALL SELECT * FROM o),
p AS (SELECT a.c, a.d, max(a.size) AS size, string_agg(b.e, '' ORDER BY b.d) AS k FROM z AS a JOIN z AS b ON a.c=b.c AND b.d<=a.d GROUP BY a.c, a.d),
e AS (SELECT c, max(d) AS d FROM z GROUP BY c),
n AS (SELECT d, k, min(c) AS c, count(*) AS n, max(size) AS size FROM p GROUP BY d, k),
kids AS (SELECT d, left(k, greatest(0, length(k)-64)) AS k, count(*) AS n FROM n WHERE d>0 GROUP BY ALL),
f AS (SELECT n.d, n.k, n.c, n.n, coalesce(kids.n,0) AS kids, (n.n-1)*n.size AS saved FROM n LEFT JOIN kids ON kids.d=n.d+1 AND kids.k=n.k),
sub AS (SELECT DISTINCT a.d, a.k, b.d AS d2, b.k AS k2 FROM p AS a JOIN p AS b ON a.c=b.c AND a.d<=b.d),
sums AS (SELECT sub.d, sub.k, sum(CASE WHEN f.kids=0 THEN 1 ELSE 0 END) AS leaves, sum(f.saved) AS saved FROM sub JOIN f ON f.d=sub.d2 AND f.k=sub.k2 GROUP BY sub.d, sub.k),
ends AS (SELECT p.d, p.k, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN e ON e.c=p.c AND e.d=p.d GROUP BY p.d, p.k)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, up.c AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children, sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens,
  sha256(coalesce(ends.ids,'')) AS ends_sha256
FROM f JOIN sums ON sums.d=f.d AND sums.k=f.k LEFT JOIN ends ON ends.d=f.d AND ends.k=f.k LEFT JOIN n AS up ON f.d>0 AND up.d=f.d-1 AND up.k=left(f.k, greatest(0, length(f.k)-64))"""


@query("op13_prefix_trie", _op13_sql())
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of conversations that start with up to five turns of the first of their hundred."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    conv = F.col("conv")
    return prefix_trie.prefix_trie(rows, base=conv - conv % 100, take=F.crc32(conv.cast("string").cast("binary")) % 6, most=5)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)

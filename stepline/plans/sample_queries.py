"""Registered queries: splits, samples, shuffles, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepline.functions import prob
from stepline.functions.hashing import fraction_split, hex_mod, keyed, uniform, uniform_int
from stepline.functions.text import hostname, norm_goal
from stepline.operators import sampling as S
from stepline.operators.ordering import first_per_group, hash_position, order_statistics
from stepline.plans import oracle as O
from stepline.plans import views as V
from stepline.plans.registry import query
from stepline.sources.tables import table

_HOST = "lower(regexp_extract(url,'^https?://([^/:?#]+)',1))"
_SPLIT = "CASE WHEN {u}<0.1::DOUBLE THEN 'test' WHEN {u}<0.1::DOUBLE+0.1::DOUBLE THEN 'dev' ELSE 'train' END"


@query(
    "hash_split",
    O.sql("", f"SELECT page_id, host, {_SPLIT.format(u='u')} AS split FROM (SELECT *, {O.unit(O.key(0, 'host'))} AS u FROM h)", h=f"SELECT page_id, {_HOST} AS host FROM pages"),
)
def hash_split(spark, folder):
    p = table(spark, folder, "pages").select("page_id", hostname(F.lit(""), "url").alias("host"))
    return p.withColumn("split", fraction_split(keyed(0, "host"), 0.1, 0.1))


_CONV_TASK = "'task-'||conv_id"


@query(
    "hash_mod_split",
    O.sql(
        "",
        f"""SELECT conv_id, turn, CASE WHEN {O.hex_mod(O.key(0, 'task'), 2)}=0 THEN 'dev' ELSE 'test' END AS eval_split,
        CASE WHEN {O.hex_mod('sha256(task)', 1000)}<80 THEN 'dev' ELSE 'train' END AS train_split
        FROM (SELECT *, {_CONV_TASK} AS task FROM conversations)""",
    ),
)
def hash_mod_split(spark, folder):
    c = table(spark, folder, "conversations").withColumn("task", F.concat(F.lit("task-"), F.col("conv_id")))
    return c.select(
        "conv_id",
        "turn",
        F.when(hex_mod(keyed(0, "task"), 2) == 0, "dev").otherwise("test").alias("eval_split"),
        F.when(hex_mod(F.sha2("task", 256), 1000) < 80, "dev").otherwise("train").alias("train_split"),
    )


@query(
    "keyed_shuffle",
    f"SELECT doc_id, row_number() OVER (ORDER BY {O.key(7, 'doc_id')}, doc_id) AS position FROM documents",
)
def keyed_shuffle(spark, folder):
    return hash_position(table(spark, folder, "documents").select("doc_id"), keyed(7, "doc_id"), "doc_id").select(
        "doc_id", F.col("position").cast("long").alias("position")
    )


@query(
    "fraction_split",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {O.key(0, 'doc_id')}, doc_id)<=floor(0.8::DOUBLE*(SELECT count(*) FROM documents))
    THEN 'train' ELSE 'dev' END AS split FROM documents""",
)
def fraction_split_docs(spark, folder):
    return S.cut_fraction(table(spark, folder, "documents").select("doc_id"), keyed(0, "doc_id"), "doc_id", 0.8)


@query(
    "hash_order_limit",
    f"SELECT c_custkey, c_name FROM customer ORDER BY {O.key(0, 'c_custkey')}, c_custkey LIMIT 400",
)
def hash_order_limit(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_name")
    return c.orderBy(keyed(0, "c_custkey"), "c_custkey").limit(400)


@query(
    "stratified_round_robin",
    f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {O.key(0, 'doc_id')}, doc_id) AS rn
    FROM documents) ORDER BY rn, source LIMIT 333""",
)
def stratified_round_robin(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source")
    return S.stratified(d, "source", keyed(0, "doc_id"), "doc_id", 333).select("doc_id", "source")


@query(
    "capped_class_sample",
    O.sql(
        "steps",
        f"""SELECT step_id, operation FROM steps WHERE operation='TYPE_TEXT' UNION ALL
        SELECT step_id, operation FROM (SELECT step_id, operation, row_number() OVER (ORDER BY {O.key(0, 'step_id')}, step_id) AS rn FROM steps
        WHERE operation<>'TYPE_TEXT') WHERE rn<=greatest(0, 6000-(SELECT count(*) FROM steps WHERE operation='TYPE_TEXT'))""",
    ),
)
def capped_class_sample(spark, folder):
    s = V.steps(spark, folder).select("step_id", "operation")
    return S.keep_class_and_fill(s, F.col("operation") == "TYPE_TEXT", keyed(0, "step_id"), "step_id", 6000)


@query(
    "option_cap_sample",
    f"""SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand
    ORDER BY (lower(p_name)='red ring') DESC, {O.key(0, 'p_partkey')}, p_partkey) AS rn FROM part) WHERE rn<=60""",
)
def option_cap_sample(spark, folder):
    p = table(spark, folder, "part").select("p_brand", "p_partkey", "p_name")
    out = S.capped_options(p, ["p_brand"], F.lower("p_name") == "red ring", keyed(0, "p_partkey"), "p_partkey", 60)
    return out.select("p_brand", "p_partkey")


@query(
    "subsample_n",
    f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {O.key(3, 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn<=250",
)
def subsample_n(spark, folder):
    return S.first_by_hash(table(spark, folder, "documents").select("doc_id"), keyed(3, "doc_id"), "doc_id", 250)


@query(
    "top_k_options",
    O.sql(
        "opts",
        """SELECT step_id, qid, row_number() OVER (PARTITION BY step_id,qid ORDER BY p DESC, j) AS rank, key, round(p,6) AS p
        FROM opts QUALIFY rank<=3""",
    ),
)
def top_k_options(spark, folder):
    q = V.question_rows(V.with_questions(V.steps(spark, folder))).select("step_id", "qid", "keys", "p")
    ranked = F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("m"), i.alias("i"))))
    top = q.select("step_id", "qid", "keys", F.posexplode(F.slice(ranked, 1, 3)).alias("r", "o"))
    return top.select(
        "step_id",
        "qid",
        (F.col("r") + 1).cast("long").alias("rank"),
        F.col("keys")[F.col("o.i")].alias("key"),
        F.round(-F.col("o.m"), 6).alias("p"),
    )


@query(
    "mixed_policy_draw",
    O.sql("steps", f"SELECT step_id, CASE WHEN {O.unit(O.key('beta', 'step_id'))}<0.5::DOUBLE THEN 'student' ELSE 'teacher' END AS actor FROM steps"),
)
def mixed_policy_draw(spark, folder):
    s = V.steps(spark, folder)
    return s.select("step_id", F.when(uniform("beta", "step_id") < 0.5, "student").otherwise("teacher").alias("actor"))


_CITIES = "SELECT DISTINCT n_name AS name FROM nation JOIN customer ON c_nationkey=n_nationkey"
def _sql_rounds() -> str:
    """The keyed permutation of the numbers below side * side, as nested selects."""
    out = "SELECT position, n, side, step, number//side AS l, number%side AS r FROM walk WHERE step=0 OR number>=n"
    for k in range(S.ROUNDS):
        drawn = f"floor({O.unit(O.key('pairs-order', str(k), 'r'))}*side)::BIGINT"
        out = f"SELECT position, n, side, step, r AS l, (l+{drawn})%side AS r FROM ({out})"
    return out


_NAMED = f"SELECT name, row_number() OVER (ORDER BY {O.key('pairs', 'name')}, name)-1 AS at FROM cities"
_SIDE = "SELECT n, ceil(sqrt(n::DOUBLE))::BIGINT AS side FROM (SELECT (count(*)*(count(*)-1))::BIGINT AS n FROM cities)"
# a pair number walks the permutation of the next square until it is a pair's
_WALK = f"""SELECT i+1 AS position, n, side, i AS number, 0 AS step FROM (SELECT n, side, unnest(range(0, n)) AS i FROM sides)
  UNION ALL SELECT position, n, side, l*side+r, step+1 FROM ({_sql_rounds()})"""
_PAIRS = """SELECT position, x.name AS a, y.name AS b FROM (
  SELECT position, number//(m-1) AS i, CASE WHEN number%(m-1)>=number//(m-1) THEN number%(m-1)+1 ELSE number%(m-1) END AS j
  FROM (SELECT * FROM walk WHERE step>0 AND number<n), (SELECT count(*) AS m FROM named)) p JOIN named x ON x.at=p.i JOIN named y ON y.at=p.j"""
_PLACED = "SELECT a, b, position FROM pairs"
_N_TRAIN, _N_EVAL = 150, 20


# what the pairs of a query are made of
PLACED = dict(cities=_CITIES, named=_NAMED, sides=_SIDE, walk=_WALK, pairs=_PAIRS, placed=_PLACED)


def pairs_sql(body: str, **extra: str) -> str:
    """A query over ``placed`` (position, a, b)."""
    return O.sql("", body, **PLACED, **extra).replace("WITH ", "WITH RECURSIVE ", 1)


def _placed_pairs(spark, folder, first=None):
    n = table(spark, folder, "nation").join(table(spark, folder, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return S.shuffled_pairs(n, "n_name", first)


@query(
    "city_pairs",
    pairs_sql(f"""SELECT a, b, CASE WHEN position<={_N_TRAIN} THEN 'train' ELSE 'eval' END AS split FROM placed WHERE position<={_N_TRAIN + _N_EVAL}"""),
)
def city_pairs(spark, folder):
    p = _placed_pairs(spark, folder, _N_TRAIN + _N_EVAL)
    return p.select("a", "b", F.when(F.col("position") <= _N_TRAIN, "train").otherwise("eval").alias("split"))


@query(
    "disjoint_slices",
    pairs_sql("""SELECT 'task-'||lpad((position-1)::VARCHAR,5,'0') AS id, a, b, CASE WHEN position<=100 THEN 'train' WHEN position<=150 THEN 'eval' ELSE 'spare' END AS split FROM placed"""),
)
def disjoint_slices(spark, folder):
    at = F.col("position")
    return _placed_pairs(spark, folder).select(
        F.format_string("task-%05d", at - 1).alias("id"),
        "a",
        "b",
        F.when(at <= 100, "train").when(at <= 150, "eval").otherwise("spare").alias("split"),
    )


_MONTHS = [("October", 2026), ("November", 2026), ("December", 2026), ("January", 2027), ("February", 2027)]  # fixed values
_ONE_WAY = "Find one-way flights from {a} to {b} on {month} {day}, {year}, for one adult in economy. Stop when matching flight options are visible."
_RETURN = (
    "Find round-trip flights from {a} to {b}, departing {month} {day} and returning {month} {back}, {year}, "
    "for one adult in economy. Stop when matching flight options are visible."
)


def _sql_template(t: str) -> str:
    for name in ("a", "b", "month", "day", "back", "year"):
        t = t.replace("{" + name + "}", f"'||{name}||'")
    return f"'{t}'"


def flight_goal(a, b, seed="flights"):
    """Goal text with a keyed date; six in ten are one-way."""
    mi = uniform_int(seed + "-month", 0, len(_MONTHS) - 1, a, b)
    month = F.element_at(F.array(*[F.lit(m) for m, _ in _MONTHS]), (mi + 1).cast("int"))
    year = F.element_at(F.array(*[F.lit(y) for _, y in _MONTHS]), (mi + 1).cast("int"))
    day = uniform_int(seed + "-day", 1, 28, a, b)
    back = F.least(F.lit(28), day + uniform_int(seed + "-stay", 2, 10, a, b))

    def fill(t: str):
        marked = t.replace("{back}", "\0back\0")
        values = {"a": F.col(a), "b": F.col(b), "month": month, "day": day, "back": back, "year": year}
        for name in values:
            marked = marked.replace("{" + name + "}", f"\0{name}\0")
        return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(marked.split("\0"))])

    return F.when(uniform(seed + "-way", a, b) < 0.6, fill(_ONE_WAY)).otherwise(fill(_RETURN))


def _sql_int(purpose: str, lo: int, hi: int) -> str:
    return f"({lo}+floor({O.unit(O.key(purpose, 'a', 'b'))}*{hi - lo + 1}))::BIGINT"


_GOALS = f"""SELECT position, a, b, CASE WHEN {O.unit(O.key('flights-way', 'a', 'b'))}<0.6::DOUBLE THEN {_sql_template(_ONE_WAY)} ELSE {_sql_template(_RETURN)} END AS goal
  FROM (SELECT *, (['October','November','December','January','February'])[mi+1] AS month, ([2026,2026,2026,2027,2027])[mi+1] AS year,
    least(28, day+stay) AS back FROM (SELECT *, {_sql_int('flights-month', 0, 4)} AS mi, {_sql_int('flights-day', 1, 28)} AS day,
    {_sql_int('flights-stay', 2, 10)} AS stay FROM placed))"""


@query("task_goal_text", pairs_sql("SELECT a, b, goal FROM goals", goals=_GOALS))
def task_goal_text(spark, folder):
    return _placed_pairs(spark, folder).select("a", "b", flight_goal("a", "b").alias("goal"))


_TOPICS = """SELECT t, row_number() OVER (ORDER BY sha256('topics:'||t), t) AS position FROM (SELECT DISTINCT p_name AS t FROM part)"""


@query(
    "tasks_union",
    pairs_sql(
        f"""SELECT 'flights' AS source, split, goal FROM (SELECT goal, CASE WHEN position<={_N_TRAIN} THEN 'train' ELSE 'eval' END AS split FROM goals WHERE position<={_N_TRAIN + _N_EVAL})
        UNION ALL SELECT 'wikipedia', CASE WHEN position<=30 THEN 'train' ELSE 'eval' END, 'Find and open the Wikipedia article about '||t||'.' FROM topics
        UNION ALL SELECT 'walks', CASE WHEN conv_id%2=0 THEN 'train' ELSE 'eval' END, {O.norm('text')} FROM conversations WHERE turn=0""",
        goals=_GOALS,
        topics=_TOPICS,
    ),
)
def tasks_union(spark, folder):
    from stepline.functions.text import norm_ws

    f = city_pairs(spark, folder).select(F.lit("flights").alias("source"), "split", flight_goal("a", "b").alias("goal"))
    topics = table(spark, folder, "part").select(F.col("p_name").alias("t")).distinct()
    t = hash_position(topics, keyed("topics", "t"), "t").select(
        F.lit("wikipedia").alias("source"),
        F.when(F.col("position") <= 30, "train").otherwise("eval").alias("split"),
        F.concat(F.lit("Find and open the Wikipedia article about "), F.col("t"), F.lit(".")).alias("goal"),
    )
    c = table(spark, folder, "conversations").filter("turn = 0").select(
        F.lit("walks").alias("source"),
        F.when(F.col("conv_id") % 2 == 0, "train").otherwise("eval").alias("split"),
        norm_ws("text").alias("goal"),
    )
    return f.unionByName(t).unionByName(c)


@query(
    "train_variants",
    O.sql(
        "",
        f"""SELECT split, variant, skipped, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, count(DISTINCT l_orderkey) AS orders FROM (
        SELECT *, (l_partkey+variant*l_linenumber)%7=0 AS skipped, coalesce(max(((l_partkey+variant*l_linenumber)%7=0)::INT)
          OVER (PARTITION BY rid ORDER BY variant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM (
        SELECT l.*, unnest(CASE WHEN split='train' THEN [1,2,3] ELSE [1] END)::BIGINT AS variant FROM (
        SELECT *, {_SPLIT.format(u='u')} AS split FROM (SELECT *, {O.unit(O.key(0, 'l_orderkey'))} AS u, row_number() OVER () AS rid FROM lineitem)) l)) WHERE stopped=0 GROUP BY ALL""",
    ),
)
def train_variants(spark, folder):
    """Variants of every line, three in training; a variant that cannot be made stops the ones after it."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    li = li.withColumn("split", fraction_split(keyed(0, "l_orderkey"), 0.1, 0.1))
    fails = lambda v: (F.col("l_partkey") + v * F.col("l_linenumber")) % 7 == 0
    v = S.repeat_until(li, F.when(F.col("split") == "train", 3).otherwise(1), fails, "variant")
    return v.groupBy("split", F.col("variant").cast("long").alias("variant"), "skipped").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"), F.countDistinct("l_orderkey").alias("orders")
    )


# ---- set operations


@query(
    "weighted_mix",
    """SELECT lang, copy, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (
    SELECT lang, n_chars, unnest(range(1, CASE lang WHEN 'fr' THEN 3 WHEN 'de' THEN 4 ELSE 2 END))::BIGINT AS copy FROM documents) GROUP BY ALL""",
)
def weighted_mix(spark, folder):
    d = table(spark, folder, "documents").select("lang", "n_chars")
    times = F.when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(1)
    m = S.repeat_rows(d, times)
    return m.groupBy("lang", F.col("copy").cast("long").alias("copy")).agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars")
    )


@query(
    "union_collections",
    """SELECT 'pages_config' AS config, 'documents' AS collection, 'd'||doc_id AS id, length(text)::BIGINT AS chars FROM documents UNION ALL
    SELECT 'pages_config', 'conversations', 'c'||conv_id||'-'||turn, length(text) FROM conversations""",
)
def union_collections(spark, folder):
    parts = [
        table(spark, folder, "documents").select(F.lit("documents").alias("collection"), F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.length("text").cast("long").alias("chars")),
        table(spark, folder, "conversations").select(F.lit("conversations").alias("collection"), F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn")).alias("id"), F.length("text").cast("long").alias("chars")),
    ]
    return parts[0].unionByName(parts[1]).withColumn("config", F.lit("pages_config"))


@query(
    "bench_union",
    O.sql(
        "",
        " UNION ALL ".join(
            f"SELECT doc_id, 'c{i}' AS bench_subset FROM documents WHERE doc_id%6={i} AND n_chars%300 BETWEEN 1 AND 255 AND {O.unit(O.key(0, 'source', 'doc_id'))}<0.5::DOUBLE"
            for i in range(5)
        ),
    ),
)
def bench_union(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    test = d.filter(uniform(0, "source", "doc_id") < 0.5)
    n_options = F.col("n_chars") % 300
    servable = test.filter(n_options.between(1, prob.MAX_OPTIONS))
    # five configs of one scan: the tag is a column, not five scans with a union
    return servable.filter(F.col("doc_id") % 6 < 5).select(
        "doc_id", F.concat(F.lit("c"), F.col("doc_id") % 6).alias("bench_subset")
    )


@query(
    "config_intersect",
    """SELECT r_name AS config FROM region WHERE r_regionkey<4 INTERSECT
    SELECT r_name FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE c_acctbal>9000""",
)
def config_intersect(spark, folder):
    r = table(spark, folder, "region")
    built = (
        table(spark, folder, "customer").filter("c_acctbal > 9000").select("c_nationkey").distinct()
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("config"))
    )
    return r.filter("r_regionkey < 4").select(F.col("r_name").alias("config")).intersect(built)


@query(
    "goal_intersect",
    O.sql(
        "states",
        f"SELECT DISTINCT {O.norm_goal('state')} AS goal FROM states WHERE {O.norm_goal('state')} IN (SELECT {O.norm_goal('text')} FROM benchmark)",
    ),
)
def goal_intersect(spark, folder):
    a = V.states(spark, folder).select(norm_goal("state").alias("goal"))
    b = table(spark, folder, "benchmark").select(norm_goal("text").alias("goal"))
    return a.join(b, "goal", "left_semi").distinct()


@query(
    "option_subset",
    O.sql(
        "qs",
        """SELECT subset_of, in_tolerance, count(*) AS n FROM (
        SELECT step_id%71<>0 AS subset_of, step_id%79<>0 AS in_tolerance FROM qs WHERE step_id%97<>0 AND step_id%83<>0) GROUP BY ALL""",
    ),
)
def option_subset(spark, folder):
    s = V.with_answers(V.with_questions(V.steps(spark, folder)))
    a = s.select("step_id", F.explode_outer("answers").alias("a")).filter("a.probabilities is not null")
    offered = F.when(F.col("step_id") % 71 == 0, F.slice("a.options", 2, 255)).otherwise(F.col("a.options"))
    extra = F.size(F.array_except(F.map_keys("a.probabilities"), offered))
    mass = prob.total(F.map_values("a.probabilities"))
    return a.groupBy(
        (extra == 0).alias("subset_of"), (F.abs(mass - 1) <= prob.SUM_TOLERANCE).alias("in_tolerance")
    ).agg(F.count("*").alias("n"))


# ---- batches


@query(
    "length_bucket_batches",
    f"""WITH RECURSIVE o AS (SELECT n_chars AS length, row_number() OVER (ORDER BY {O.key('batches', 'doc_id')}, doc_id) AS position FROM documents),
    s AS (SELECT (position-1)//{S.WINDOW_ROWS} AS win, length, row_number() OVER (PARTITION BY (position-1)//{S.WINDOW_ROWS} ORDER BY length, position) AS i FROM o),
    b AS (SELECT win, i, length, 0 AS batch, 1 AS held FROM s WHERE i=1
      UNION ALL SELECT s.win, s.i, s.length, CASE WHEN s.length*(b.held+1)>100000 THEN b.batch+1 ELSE b.batch END, CASE WHEN s.length*(b.held+1)>100000 THEN 1 ELSE b.held+1 END
      FROM b JOIN s ON s.win=b.win AND s.i=b.i+1)
    SELECT win::BIGINT AS "window", batch::BIGINT AS batch, count(*) AS n, max(length) AS longest, max(length)*count(*) AS padded FROM b GROUP BY win, batch""",
)
def length_bucket_batches(spark, folder):
    d = table(spark, folder, "documents")
    b = S.length_batches(d, "doc_id", "n_chars", keyed("batches", "doc_id"), 100_000)
    return b.groupBy("window", "batch").agg(
        F.count("*").alias("n"), F.max("length").alias("longest"), (F.max("length") * F.count("*")).alias("padded")
    )


@query(
    "shard_plan",
    O.sql(
        "",
        f"""SELECT batch, pos%4 AS shard FROM (SELECT batch, position-1-5 AS pos, count(*) OVER ()-5 AS n FROM placed)
        WHERE pos>=0 AND pos<n-n%4""",
        o=f"SELECT doc_id, row_number() OVER (ORDER BY {O.key(1, 'doc_id')}, doc_id) AS position FROM documents",
        b="SELECT DISTINCT (position-1)//16 AS batch FROM o",
        placed=f"SELECT batch, row_number() OVER (ORDER BY {O.key('plan', 'batch')}, batch) AS position FROM b",
    ),
)
def shard_plan(spark, folder):
    d = hash_position(table(spark, folder, "documents").select("doc_id"), keyed(1, "doc_id"), "doc_id")
    batches = d.select(F.floor((F.col("position") - 1) / 16).alias("batch")).distinct()
    n = batches.count()
    plan = hash_position(batches, keyed("plan", "batch"), "batch")
    shard = S.shard_of(F.col("position") - 1, F.lit(n), start=5, world=4)
    return plan.select("batch", shard.alias("shard")).filter("shard is not null")


@query(
    "skip_warmup",
    O.sql(
        "steps",
        """SELECT subset, count(*) FILTER (WHERE NOT long) AS n, round(quantile_cont(value,0.5) FILTER (WHERE NOT long),1) AS median,
        (array_agg(value ORDER BY value) FILTER (WHERE NOT long))[floor(0.9::DOUBLE*(count(*) FILTER (WHERE NOT long)-1))::BIGINT+1] AS p90,
        (max(n_long))::BIGINT AS too_long FROM (
        SELECT *, k>90 AS long, row_number() OVER (PARTITION BY subset ORDER BY step_id) AS i, count_if(k>90) OVER (PARTITION BY subset) AS n_long FROM steps)
        WHERE i>5 GROUP BY subset""",
    ),
)
def skip_warmup(spark, folder):
    s = V.steps(spark, folder).select("step_id", "subset", "value", "k")
    warm = first_per_group(s, ["subset"], [F.col("step_id")], 5).select("subset", "step_id")
    long = F.col("k") > 90
    timed = s.filter(~long).join(warm, ["subset", "step_id"], "left_anti")
    stats = order_statistics(timed, ["subset"], "value", {"median": (0.5, "linear"), "p90": (0.9, "lower")})
    out = s.groupBy("subset").agg(F.count_if(long).alias("too_long"))
    return stats.join(out, "subset").select("subset", "n", F.round("median", 1).alias("median"), "p90", "too_long")

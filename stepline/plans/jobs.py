"""Registered jobs: whole conversions, corpora and the published dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepline.functions import actions as A
from stepline.functions import text as T
from stepline.functions.hashing import fraction_split, hex_mod, keyed
from stepline.operators import convert as C
from stepline.operators import dataset as D
from stepline.operators import pages as P
from stepline.operators import privacy as R
from stepline.operators import prompts
from stepline.operators import sampling as S
from stepline.operators.ordering import hash_position, preceding_rows
from stepline.plans import oracle as O
from stepline.plans import page_queries as PQ
from stepline.plans import privacy_queries as PR
from stepline.plans import row_queries as RQ
from stepline.plans import sample_queries as SQ
from stepline.plans import views as V
from stepline.plans.registry import query
from stepline.session import materialize, scratch_path
from stepline.sources import steps as IO
from stepline.sources.tables import table


def sql_text(text):
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


LABEL_CHARS = 202  # the converters clip labels and values to 100 characters after trimming


def _no_history():
    return F.array().cast(f"array<{A.ENTRY_TYPE}>")


def described_pages(spark, folder):
    """Described elements of all pages, parsed once and kept as a table; each page's language and title; each page's text."""
    nodes = materialize(P.page_nodes(table(spark, folder, "pages"), text_chars=LABEL_CHARS), "nodes")
    d = P.describe(nodes)
    weight = F.when(F.col("tag").isin(*P.INTERACTIVE_TAGS) | F.col("role").isin(*P.INTERACTIVE_ROLES), 3.0).otherwise(1.0)
    candidate = F.col("acts") & ~F.col("hidden") & (F.col("tag") != "option") & ~F.col("in_select")
    listed = F.coalesce("options", F.array().cast("array<struct<label:string,value:string>>"))
    d = d.withColumns({"weight": weight, "candidate": candidate, "options": listed})
    d = materialize(d.select("page_id", "pre", "last", "parent", "tag", "attrs", "role", "label", "value", "operations", "options", "candidate", "weight", "hidden", "acts"), "described")
    texts = P.page_text(P.page_texts(nodes))
    titles = nodes.filter("tag = 'title'").groupBy("page_id").agg(T.clip(F.min_by("text", "pre")).alias("title"))
    langs = nodes.filter("pre = 0").select("page_id", F.lower(F.coalesce(F.try_element_at("attrs", F.lit("lang")), F.lit(""))).alias("lang"))
    return d, langs.join(titles, "page_id", "left"), texts


def page_steps(spark, folder, nodes, about):
    """One recorded click per page, with up to three candidate nodes."""
    positives = PQ._positives(spark, folder)
    gold = PQ.gold_of(positives, nodes).select("page_id", "gold")
    p = table(spark, folder, "pages").select("page_id", "url").join(positives, "page_id").join(gold, "page_id", "left").join(about, "page_id", "left")
    early = A.first_failure([(F.size("cands") == 0, "no_positive"), (F.col("gold").isNull(), "positive_not_in_html")])
    return p.select(
        F.col("page_id").cast("string").alias("step_id"), "page_id", "gold", F.col("gold").alias("hit"), F.lit("CLICK").alias("op"),
        F.lit(None).cast("string").alias("wanted"), F.concat(F.lit("Open page "), F.col("page_id")).alias("goal"), F.lit("").alias("url"),
        T.hostname(F.lit(None).cast("string"), "url").alias("title"), F.coalesce("page_text", F.lit("")).alias("page_text"), _no_history().alias("history"), early.alias("skip_reason"),
        F.col("cands").alias("positives"),
    )


@query("job_convert_pages")
def job_convert_pages(spark, folder):
    """Human traces: pages with candidate lists → labelled steps by site split, or their skip reason."""
    nodes, about, texts = described_pages(spark, folder)
    out = C.convert_steps(nodes, page_steps(spark, folder, nodes, about.join(texts, "page_id", "left")), k_min=4)
    return out.select("step_id", F.col("title").alias("website"), fraction_split(keyed(0, "title"), 0.1, 0.1).alias("split"), "op", "gold_label", "k", "has_target", "skip_reason", "request", "labels")


@query("assemble_request")
def assemble_request(spark, folder):
    out = job_convert_pages(spark, folder).filter("skip_reason is null")
    q = F.from_json(F.get_json_object("request", "$.questions"), "map<string,struct<criteria:string>>")
    return out.select(
        "step_id", "labels", F.map_keys(q).alias("qids"), F.json_array_length(F.get_json_object("request", "$.state.elements")).alias("n_elements"),
        F.size(F.json_object_keys(F.try_element_at(q, F.lit("operation"))["criteria"])).alias("n_operations"),
    )


def trace_actions(spark, folder):
    """Conversation turns as recorded page actions: kind, selector, address of the snapshot."""
    c = table(spark, folder, "conversations")
    n = table(spark, folder, "pages").agg(F.max("page_id").alias("m")).first()["m"] + 1
    t = F.col("turn") % 6
    kind = F.element_at(F.array(*[F.lit(x) for x in ("click", "hover", "type", "drag", "double_click", "paste")]), (t + 1).cast("int"))
    return c.select(
        "conv_id", "turn", kind.alias("action_type"), (F.col("conv_id") % 11 != 0).alias("included"),
        ((F.col("conv_id") * 7 + F.col("turn")) % n).alias("page_id"),
        F.element_at(F.array(F.lit("h1"), F.lit("nav"), F.lit("article"), F.lit("title")), (F.col("turn") % 4 + 1).cast("int")).alias("selector"),
        F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")).alias("value"), F.lit("{}").alias("attributes"),
        F.when(t.isin(2, 5), T.norm_ws("text")).otherwise("no input text").alias("input_text"),
    )


@query("job_convert_traces")
def job_convert_traces(spark, folder):
    """Page traces: actions with snapshots and selectors → labelled steps with accumulated history."""
    nodes, about, texts = described_pages(spark, folder)
    a = trace_actions(spark, folder)
    op = A.mapped(A.TRACE_OPERATIONS, F.col("action_type"))
    a = a.withColumn("op", F.when(F.col("included"), op)).withColumn("step_id", F.concat_ws("-", "conv_id", "turn"))
    a = a.withColumn("text", F.when(F.col("input_text") != "no input text", F.col("input_text")))
    pages = table(spark, folder, "pages").select("page_id", "url")
    goals = table(spark, folder, "conversations").filter("turn = 0").select("conv_id", T.clean_goal("text").alias("goal"))
    keyed_nodes = nodes.select("page_id", "pre", F.explode(F.array_compact(F.array("tag", F.when(F.try_element_at("attrs", F.lit("id")) != "", F.concat(F.lit("#"), F.try_element_at("attrs", F.lit("id"))))))).alias("selector"))
    unique = keyed_nodes.groupBy("page_id", "selector").agg(F.count("*").alias("_n"), F.min("pre").alias("hit")).filter("_n = 1").drop("_n")
    j = a.filter("op is not null").join(pages, "page_id", "left").join(about, "page_id", "left").join(unique, ["page_id", "selector"], "left").join(goals, "conv_id")
    gold = P.climb(nodes.select("page_id", "pre", "parent", (F.col("acts") & ~F.col("hidden")).alias("interactive")), j.select("step_id", "page_id", "hit"))
    field = nodes.filter(F.col("tag").isin("input", "textarea") & ~F.col("hidden")).select("page_id", F.col("pre").alias("_f"))
    box = nodes.select("page_id", F.col("pre").alias("hit"), F.col("last").alias("_to"), F.col("tag").alias("_tag"))
    only = (
        j.filter("op = 'TYPE_TEXT'").select("step_id", "page_id", "hit").join(box, ["page_id", "hit"]).filter(~F.col("_tag").isin("input", "textarea"))
        .join(field, "page_id").filter((F.col("_f") > F.col("hit")) & (F.col("_f") <= F.col("_to")))
        .groupBy("step_id").agg(F.count("*").alias("_n"), F.min("_f").alias("_only")).filter("_n = 1").drop("_n")
    )
    j = j.join(gold.select("step_id", "gold"), "step_id", "left").join(only, "step_id", "left").withColumn("gold", F.coalesce("_only", "gold"))
    j = j.join(texts, "page_id", "left")  # last, so that page texts, the largest column, are dealt once
    english = (F.col("lang") == "") | F.col("lang").startswith("en")
    body = F.coalesce("page_text", F.lit(""))
    early = A.first_failure(
        [(F.col("url").isNull(), "no_snapshot"), (~english, "not_english"), (F.col("hit").isNull(), "selector_unresolved"), (T.cjk_share(body) > 0.05, "not_english")]
    )
    j = j.withColumn("skip_reason", early)
    # history counts every kept action, converted or not: a first pass settles the labels
    base = j.select("step_id", "page_id", "conv_id", "turn", "gold", "hit", "op", F.coalesce("text", "value").alias("wanted"), "goal", "url", F.coalesce("title", F.lit("")).alias("title"), body.alias("page_text"), "skip_reason", "text", "value", "attributes")
    base = materialize(base.withColumn("history", _no_history()), "trace-steps")
    first = C.convert_steps(nodes, base, k_min=4)
    label = F.when(F.col("skip_reason").isNull(), F.col("gold_label")).otherwise(T.fallback_label("value", "attributes"))
    entry = A.entry(A.select_label(F.col("op"), label, F.col("text")), A.mapped(A.ENTRY_KIND, F.col("op")), F.when(F.col("op") == "TYPE_TEXT", F.col("text")))
    past = preceding_rows(first.select("step_id", "conv_id", "turn", entry.alias("e")), ["conv_id"], "turn", F.col("e"), A.HISTORY_STEPS, "past")
    done = first.join(past.select("step_id", "past"), "step_id", "left")
    request = F.replace(F.col("request"), F.lit('"recent_actions":[]'), F.concat(F.lit('"recent_actions":'), F.to_json("past")))
    return done.select("step_id", "conv_id", "turn", "op", "gold_label", "k", "skip_reason", F.size("past").alias("n_history"), request.alias("request"), "labels")


def tree_prompts(spark, folder):
    """Recorded prompts over the conversation trees, with a reply each."""
    t = PQ.trees(spark, folder)
    i = F.col("tree_id")
    act = (
        F.when(i % 5 == 0, "click [11]").when(i % 5 == 1, "type [10] [some words] [1]").when(i % 5 == 2, "stop [N/A]")
        .when(i % 5 == 3, "scroll [up]").otherwise("stop [the answer]")
    )
    prompt = F.concat(
        F.lit("OBSERVATION:\n"), F.col("tree"), F.lit("\nURL: http://chat/"), i, F.lit("\nOBJECTIVE: Find topic "), i % 20,
        F.lit("\nPREVIOUS ACTIONS:\n1: None\n2: scroll [down]\n3: click [11] where [11] is Menu\n<|eot_id|>"),
    )
    return t.select(F.col("tree_id"), F.concat(F.lit("task-"), i % 20).alias("task"), prompt.alias("prompt"), F.concat(F.lit("So ```"), act, F.lit("```")).alias("output"))


@query("job_convert_trees")
def job_convert_trees(spark, folder, train_rows=None):
    """Accessibility trees: prompt and reply → labelled steps, the rest split by task.

    With ``train_rows``, the train split keeps every step of the rare class and others up to so many rows.
    """
    r = tree_prompts(spark, folder).withColumn("p", A.parse_prompt("prompt")).withColumn("a", A.parse_reply("output"))
    r = r.withColumn("op", A.reply_operation(F.col("a"))).withColumn("history", A.last_items(F.array_compact(F.transform("p.history", A.parse_history_line))))
    nodes = materialize(P.ax_tree_nodes(r.select("tree_id", F.col("p.tree").alias("tree"))), "tree-nodes")
    about = P.tree_page(nodes)
    inside = F.col("role") != "RootWebArea"
    acts = F.col("role").isin(*P.TREE_INTERACTIVE) | F.contains("props", F.lit("clickable"))
    ops = F.when(F.col("role").isin(*P.TREE_EDITABLE), F.array(F.lit("TYPE_TEXT"), F.lit("CLICK"))).otherwise(F.array(F.lit("CLICK")))
    n = nodes.filter(inside).select(
        F.col("tree_id").alias("page_id"), "pre", "last", F.col("role").alias("tag"), "role", "label", F.lit(None).cast("string").alias("value"), ops.alias("operations"),
        F.array().cast("array<struct<label:string,value:string>>").alias("options"), (F.col("id").isNotNull() & acts).alias("candidate"),
        F.when(F.col("role").isin(*P.TREE_INTERACTIVE), 3.0).otherwise(1.0).alias("weight"), F.lit(False).alias("hidden"), "id",
    )
    targeted = F.col("op").isin("CLICK", "TYPE_TEXT")
    at = n.filter("id is not null").groupBy("page_id", "id").agg(F.max("pre").alias("gold"))
    r = r.withColumn("_id", F.when(targeted, F.element_at("a.args", 1)))
    s = r.join(at.withColumnsRenamed({"page_id": "tree_id", "id": "_id"}), ["tree_id", "_id"], "left").join(about, "tree_id", "left")
    early = A.first_failure(
        [(F.col("a").isNull(), "no_action"), (F.col("p.objective") == "", "no_objective"), (targeted & F.col("gold").isNull(), "target_not_in_tree")]
    )
    steps = s.select(
        F.col("tree_id").cast("string").alias("step_id"), F.col("tree_id").alias("page_id"), "gold", F.col("gold").alias("hit"), "op", F.lit(None).cast("string").alias("wanted"),
        F.col("p.objective").alias("goal"), F.coalesce(F.nullif("p.url", F.lit("")), "root_url").alias("url"), F.coalesce("title", F.lit("")).alias("title"),
        F.substring(F.array_join("lines", "\n"), 1, P.PAGE_TEXT_CHARS).alias("page_text"), "history", early.alias("skip_reason"), "task",
    )
    done = C.convert_steps(n, steps, need_candidates=False, from_tree=True)
    kept = materialize(done.filter("skip_reason is null"), "tree-steps")
    is_train = hex_mod(keyed("src", "step_id"), 4) != 0
    train = kept.filter(is_train)
    if train_rows is not None:
        train = S.keep_class_and_fill(train, F.col("op") == "SCROLL_UP", keyed(0, "step_id"), "step_id", train_rows)
    train = train.withColumn("split", F.lit("train"))
    held = kept.filter(~is_train).withColumn("split", F.when(hex_mod(keyed(0, "task"), 2) == 0, "dev").otherwise("test"))
    rows = train.unionByName(held).unionByName(done.filter("skip_reason is not null").withColumn("split", F.lit(None).cast("string")))
    return rows.select("step_id", "split", "op", "gold_label", "k", "has_target", "skip_reason", "request", "labels")


# ---- corpora


_GENERAL = f"""SELECT 'suite' AS corpus, CASE WHEN doc_id%10=0 THEN 'test' WHEN doc_id%10=1 THEN 'dev' ELSE 'train' END AS split, doc_id, quality AS label FROM labels
  UNION ALL SELECT 'decisions', 'dev', doc_id, toxic FROM labels
  UNION ALL SELECT 'decisions-train', CASE WHEN row_number() OVER (ORDER BY {O.key(0, 'doc_id')}, doc_id)<=floor(0.8::DOUBLE*(SELECT count(*) FROM labels)) THEN 'train' ELSE 'dev' END, doc_id, toxic FROM labels"""


@query("job_general_corpora", f"SELECT corpus, split, doc_id, label FROM ({_GENERAL}) JOIN (SELECT doc_id FROM documents) USING (doc_id)")
def job_general_corpora(spark, folder):
    """Suites with embedded labels and typed-decision cases → labelled rows by split."""
    lab = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    suite = F.to_json(F.create_map(F.lit("q"), F.struct(F.lit("score").alias("type"), F.lit("good?").alias("instructions"), F.lit("[]").alias("criteria"), F.col("quality").cast("string").alias("label"))))
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    a = lab.select(F.lit("suite").alias("corpus"), split.alias("split"), "doc_id", D.split_embedded_labels(suite)["labels"]["q"].cast("int").alias("label"))
    raw = F.when(F.col("toxic") == 1, "True").otherwise("false")
    typed = lab.select("doc_id", D.cast_label(F.lit("noul"), raw)["noul"].cast("int").alias("label"))
    b = typed.select(F.lit("decisions").alias("corpus"), F.lit("dev").alias("split"), "doc_id", "label")
    c = S.cut_fraction(typed, keyed(0, "doc_id"), "doc_id", 0.8).select(F.lit("decisions-train").alias("corpus"), "split", "doc_id", "label")
    return a.unionByName(b).unionByName(c)


_EXT_N = 900
_EXTERNAL = f"""SELECT 'tasks' AS corpus, step_id::VARCHAR AS id, label FROM rc WHERE step_id IN (SELECT step_id FROM (
    SELECT step_id, subset, row_number() OVER (PARTITION BY subset ORDER BY {O.key('ext', 'step_id')}, step_id) AS rn FROM co) ORDER BY rn, subset LIMIT {_EXT_N})
  UNION ALL SELECT 'states', id, source FROM states WHERE lower({O.norm('state')}) NOT IN (SELECT lower({O.norm('text')}) FROM benchmark)"""


@query("job_external_corpora", O.sql("steps states", _EXTERNAL, co=RQ.CORPUS_SQL, rc=RQ.RECAST_SQL))
def job_external_corpora(spark, folder):
    """Corpora sampled evenly over their sources, recast as questions, cleaned of held-out states."""
    held = table(spark, folder, "benchmark")
    picked = S.stratified(RQ.corpus(spark, folder), "subset", keyed("ext", "step_id"), "step_id", _EXT_N)
    tasks = D.decontaminate(D.recast_single(picked), "state", held, "text")
    a = tasks.select(F.lit("tasks").alias("corpus"), F.col("step_id").cast("string").alias("id"), "label")
    b = D.decontaminate(V.states(spark, folder), "state", held, "text").select(F.lit("states").alias("corpus"), "id", F.col("source").alias("label"))
    return a.unionByName(b)


_TASK_ROWS = f"""SELECT source, split, goal, url, row_number() OVER (ORDER BY part, place)-1 AS n FROM (
  SELECT 0 AS part, conv_id AS place, 'walks' AS source, CASE WHEN conv_id%2=0 THEN 'train' ELSE 'eval' END AS split, goal, url FROM first
  UNION ALL SELECT 1, position, 'flights', CASE WHEN position<=150 THEN 'train' ELSE 'eval' END, goal, 'https://www.google.com/travel/flights?hl=en' FROM goals WHERE position<=170
  UNION ALL SELECT 2, position, 'wikipedia', CASE WHEN position<=30 THEN 'train' ELSE 'eval' END, 'Find and open the Wikipedia article about '||t||'.', 'https://en.wikipedia.org/wiki/Main_Page' FROM topics)"""


@query(
    "job_make_tasks",
    SQ.pairs_sql("SELECT 'task-'||lpad(n::VARCHAR,5,'0') AS id, source, split, goal, url FROM tr", goals=SQ._GOALS, topics=SQ._TOPICS, first=RQ._FIRST, tr=_TASK_ROWS),
)
def job_make_tasks(spark, folder):
    """All task sources in order, numbered: first steps, city pairs, topics."""
    walks = RQ.conversation_tasks(spark, folder).select(
        F.lit(0).alias("part"), F.col("id").alias("place"), F.lit("walks").alias("source"), F.when(F.col("id") % 2 == 0, "train").otherwise("eval").alias("split"), "goal", "url"
    )
    pairs = SQ._placed_pairs(spark, folder, 170)
    flights = pairs.select(
        F.lit(1).alias("part"), F.col("position").alias("place"), F.lit("flights").alias("source"), F.when(F.col("position") <= 150, "train").otherwise("eval").alias("split"),
        SQ.flight_goal("a", "b").alias("goal"), F.lit("https://www.google.com/travel/flights?hl=en").alias("url"),
    )
    topics = hash_position(table(spark, folder, "part").select(F.col("p_name").alias("t")).distinct(), keyed("topics", "t"), "t").select(
        F.lit(2).alias("part"), F.col("position").alias("place"), F.lit("wikipedia").alias("source"), F.when(F.col("position") <= 30, "train").otherwise("eval").alias("split"),
        F.concat(F.lit("Find and open the Wikipedia article about "), F.col("t"), F.lit(".")).alias("goal"), F.lit("https://en.wikipedia.org/wiki/Main_Page").alias("url"),
    )
    from stepline.operators.ordering import range_count, value_range, with_position

    tasks = walks.unionByName(flights).unionByName(topics)
    # one whole-number order over the parts: part in the high digits
    tasks = tasks.withColumn("_order", F.col("part") * F.lit(1 << 40) + F.col("place"))
    return with_position(value_range(tasks, "_order", range_count(tasks)), ["_order"]).select(
        F.format_string("task-%05d", F.col("position") - 1).alias("id"), "source", "split", "goal", "url"
    )


# ---- the published dataset


_CARD, _MAIL = "4111 1111 1111 1111", "someone@mail.example.org"
_OPERATION = '"operation":{"type":"choice",'
_CRITERIA = '"criteria":{"CLICK":"go","DONE":"end","write to ' + _MAIL + '":"x"},'
# some rows hold a card number in an action or in meta, or a mail address in the title; some questions lack criteria
_BUILD_ROWS = f"""SELECT * REPLACE (replace(CASE step_id%50 WHEN 7 THEN replace(request,'"action":"a"','"action":"paid by {_CARD}"') WHEN 8 THEN replace(request,'"title":"','"title":"{_MAIL} ') ELSE request END,
  '{_OPERATION}', CASE WHEN step_id%50=9 THEN '{_OPERATION}' ELSE '{_OPERATION}{_CRITERIA}' END) AS request), (step_id%50=7 AND step_id%3>0) OR step_id%50=12 AS dropped FROM sr"""
_BUILD = f"""SELECT 'rows' AS part, config, split, operation AS item, count(*) AS n FROM pub GROUP BY ALL
  UNION ALL SELECT 'removed', config, '', CASE WHEN dropped THEN 'pii' ELSE 'unloaded_done' END, count(*) FROM gone GROUP BY ALL
  UNION ALL SELECT 'bench', config, 'test', operation, count(*) FROM pub WHERE split='test' AND config<>'traces' AND step_id%50<>9 GROUP BY ALL
  UNION ALL SELECT 'overlap', config, split, CASE WHEN split='train' THEN 'train' ELSE 'other' END, count(DISTINCT session) FROM pub WHERE session%10=0 GROUP BY ALL"""
_BUILD_VIEWS = dict(
    sr=RQ.STEP_ROWS_SQL,
    br=_BUILD_ROWS,
    base="SELECT config, split, step_id, session, operation, dropped, 't'||session AS task_id, 'Goal '||session||'.' AS goal, step_id%4 AS n_elements FROM br",
    gone="SELECT * FROM base WHERE dropped OR (operation='DONE' AND n_elements=0)",
    okr="SELECT * FROM base WHERE NOT (dropped OR (operation='DONE' AND n_elements=0))",
    pub=f"""SELECT config, step_id, session, operation, CASE WHEN split<>'dev' THEN split WHEN config<>'teacher' THEN 'validation'
      WHEN task_id IN (SELECT task_id FROM okr WHERE split='train') OR {O.norm_goal('goal')} IN (SELECT {O.norm_goal('goal')} FROM okr WHERE split='train') THEN 'validation' ELSE 'test' END AS split FROM okr""",
)


def build_rows(spark, folder):
    """The derived step rows with personal data in places that no scan field names."""
    at, request = F.col("step_id") % 50, F.col("request")
    held = F.when(at == 7, F.replace(request, F.lit('"action":"a"'), F.lit(f'"action":"paid by {_CARD}"'))).when(at == 8, F.replace(request, F.lit('"title":"'), F.lit(f'"title":"{_MAIL} '))).otherwise(request)
    criteria = F.when(at == 9, F.lit(_OPERATION)).otherwise(F.lit(_OPERATION + _CRITERIA))
    meta = F.when(at == 12, F.regexp_replace("meta", r"\}$", f',"note":"paid by {_CARD}"}}')).otherwise(F.col("meta"))
    return RQ.step_rows(spark, folder).withColumns({"request": F.replace(held, F.lit(_OPERATION), criteria), "meta": meta})


@query("job_build_dataset", O.sql("steps", _BUILD, **_BUILD_VIEWS))
def job_build_dataset(spark, folder):
    """Redact → flatten → drop unloaded DONE → leak-checked splits → write → manifest, frozen bench and task overlap."""
    safe = R.redact_rows(build_rows(spark, folder), PR.NAMES, D.STATE_TYPE)
    flat = D.flatten_steps(safe, keep=("dropped",))
    text = F.coalesce(F.get_json_object("request", "$.state.page.text"), F.lit(""))
    why = F.when(F.col("dropped"), "pii").when(D.unloaded_done(F.col("operation"), F.col("n_elements"), text), "unloaded_done")
    clean = materialize(flat.withColumn("_why", why).drop("dropped"), "clean-steps")
    rows = D.leak_checked_splits(clean.filter("_why is null").drop("_why"), ["teacher"])
    path = scratch_path(spark, "dataset")
    IO.write_flat_steps(rows, path)
    out = spark.read.parquet(path)
    part = lambda name: F.lit(name).alias("part")
    by_op = out.groupBy("config", "split", "operation").agg(F.count("*").alias("n"), F.count_if(D.servable(D.n_options_of(F.col("request")))).alias("strict"))
    by_op = materialize(by_op, "dataset-counts")
    mix = by_op.select(part("rows"), "config", "split", F.col("operation").alias("item"), "n")
    frozen = by_op.filter((F.col("split") == "test") & (F.col("config") != "traces") & (F.col("strict") > 0)).select(part("bench"), "config", "split", F.col("operation").alias("item"), F.col("strict").alias("n"))
    removed = clean.filter("_why is not null").groupBy("config", F.col("_why").alias("item")).agg(F.count("*").alias("n")).select(part("removed"), "config", F.lit("").alias("split"), "item", "n")
    tasks = V.steps(spark, folder).filter(F.col("session") % 10 == 0).select(F.concat(F.lit("t"), "session").alias("id"), F.concat(F.lit("Goal "), "session", F.lit(".")).alias("goal")).distinct()
    met = D.task_overlap(out, tasks).groupBy("kind", "place").agg(F.count("*").alias("n"))
    place = F.split("place", "/")
    overlap = met.select(part("overlap"), place[0].alias("config"), place[1].alias("split"), F.col("kind").alias("item"), "n")
    return mix.unionByName(removed).unionByName(frozen).unionByName(overlap)


# ---- prompts and shrinking


@query(
    "judge_prompt",
    """SELECT conv_id, turn, 'GOAL: '||role||chr(10)||chr(10)||'URL: '||substring(repeat('http://h/'||conv_id||'/',40),1,300)||chr(10)||'TITLE: t'||turn||chr(10)||chr(10)
    ||'PAGE TEXT:'||chr(10)||substring(text,1,5000)||chr(10)||chr(10)||'INTERACTIVE ELEMENTS (sample):'||chr(10)
    ||array_to_string(list_transform(range(1,least(turn*30,40)+1), lambda i: '- ['||i||'] link: item '||i),chr(10))||chr(10)||chr(10)||'ACTIONS SO FAR:'||chr(10)
    ||CASE WHEN turn=0 THEN '- (none)' ELSE '- click: go'||chr(10)||'- fill: Name = ''x''' END AS prompt FROM conversations""",
)
def judge_prompt(spark, folder):
    c = table(spark, folder, "conversations")
    n = (F.col("turn") * 30).cast("int")
    elements = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("string").alias("index"), F.lit("link").alias("role"), F.concat(F.lit("item "), i).alias("label")))).otherwise(
        F.array().cast("array<struct<index:string,role:string,label:string>>")
    )
    none = F.lit(None)
    actions = F.when(F.col("turn") == 0, _no_history()).otherwise(F.array(A.entry(F.lit("go"), F.lit("click"), none), A.entry(F.lit("Name"), F.lit("fill"), F.lit("x"))))
    url = F.repeat(F.concat(F.lit("http://h/"), F.col("conv_id"), F.lit("/")), 40)
    return c.select("conv_id", "turn", prompts.judge_prompt(F.col("role"), url, F.concat(F.lit("t"), F.col("turn")), F.col("text"), elements, actions).alias("prompt"))


_TEACHER = f"""SELECT id, 'GOAL: '||goal||chr(10)||chr(10)||'URL: '||substring(url,1,300)||chr(10)||'TITLE: '||config||chr(10)||chr(10)||'VISIBLE PAGE TEXT:'||chr(10)||substring(text,1,6000)
  ||chr(10)||chr(10)||'ELEMENTS:'||chr(10)||concat_ws(chr(10),
    CASE WHEN id%3=0 THEN '[1] textbox ''E-mail'' value='''||mail||''' ops=TYPE_TEXT' END, CASE WHEN id%5=0 THEN '[1] textbox ''Password'' value=''hunter'||id||''' ops=TYPE_TEXT' END,
    CASE WHEN id%4=0 THEN '[1] textbox ''Country'' value='''||lang||''' ops=SELECT' END, CASE WHEN id%19=0 THEN '[1] textbox ''Card number'' value=''{PR.CARD_NUMBER}'' ops=TYPE_TEXT' END)
  ||chr(10)||chr(10)||'RECENT ACTIONS:'||chr(10)||coalesce(nullif(concat_ws(chr(10), CASE WHEN id%7=0 THEN '- fill: Your name = ''Mary Poppins''' END, CASE WHEN id%2=0 THEN '- click: Search' END),''),'- (none)')
  ||chr(10)||chr(10)||'OPERATIONS:'||chr(10)||'- CLICK: go'||chr(10)||'- DONE: end'||chr(10)||chr(10)||'VALID TARGETS PER OPERATION:'||chr(10)
  ||CASE WHEN id%400=0 THEN '- (none)' ELSE '- CLICK target keys: '||array_to_string(range(1,least(id%400,300)+1),', ') END
  ||chr(10)||chr(10)||'RULES:'||chr(10)||'be brief'||chr(10)||chr(10)||{sql_text(prompts.SAFETY_RULES)}||chr(10)||chr(10)||{sql_text(prompts.REPLY_FORMAT)} AS prompt FROM st"""


@query("teacher_prompt", O.sql("", _TEACHER, st=PR.STEPS_SQL))
def teacher_prompt(spark, folder):
    """What a teacher reads about each derived browser step, with up to 399 targets offered."""
    s = PR.browser_steps(spark, folder)
    n = (F.col("id") % 400).cast("int")
    keys = F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))
    targets = F.when(n > 0, F.array(F.struct(F.lit("CLICK").alias("operation"), keys.alias("keys")))).otherwise(F.array().cast("array<struct<operation:string,keys:array<string>>>"))
    operations = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("CLICK", "go"), ("DONE", "end"))])
    return s.select("id", prompts.teacher_prompt(F.col("goal"), F.lit("be brief"), F.col("state"), operations, targets).alias("prompt"))


@query(
    "shrink_state",
    """WITH RECURSIVE r AS (SELECT page_id, length(html)::BIGINT AS n, 0 AS cuts FROM pages UNION ALL
      SELECT page_id, greatest(200, floor(n*0.75::DOUBLE))::BIGINT, cuts+1 FROM r WHERE n>500 AND n>200)
    SELECT page_id, min(n) AS text_chars, min(n)<=500 AS fits FROM r GROUP BY page_id""",
)
def shrink_state(spark, folder):
    """The text stage: how much of each page's text is left when it must fit 500 characters."""
    p = table(spark, folder, "pages")
    left = prompts.cut_text(F.length("html"), F.lit(500))
    return p.select("page_id", left.cast("long").alias("text_chars")).withColumn("fits", F.col("text_chars") <= 500)


@query(
    "shrink_question_options",
    """SELECT doc_id, sum(length(x))::INT AS size, sum(length(x))<=2000 AS fits, string_agg(x, chr(10) ORDER BY i) AS options FROM (
      SELECT doc_id, i, CASE WHEN sum(length(o)) OVER (PARTITION BY doc_id)>2000 THEN substring(o,1,300) ELSE o END AS x FROM (
      SELECT doc_id, generate_subscripts(string_split(text,chr(10)),1) AS i, unnest(string_split(text,chr(10))) AS o FROM documents)) GROUP BY doc_id""",
)
def shrink_question_options(spark, folder):
    """The lines of a document as the options of a question of at most 2,000 characters."""
    d = table(spark, folder, "documents").where("text is not null")
    cut = d.select("doc_id", prompts.cut_options(F.split("text", "\n"), 2000).alias("q"))
    return cut.select("doc_id", "q.size", "q.fits", F.array_join("q.options", "\n").alias("options"))


@query("shrink_steps")
def shrink_steps(spark, folder):
    """All stages over the derived browser steps, with a budget in characters."""
    s = PR.browser_steps(spark, folder)
    return s.select("id", prompts.shrink(F.col("state"), 400).alias("x")).select("id", "x.stage", "x.size", "x.fits", F.to_json("x.state").alias("state"))

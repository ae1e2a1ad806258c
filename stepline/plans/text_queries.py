"""Registered queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepline.functions import actions as A
from stepline.functions import privacy as P
from stepline.functions import prob
from stepline.functions import text as T
from stepline.operators import prompts
from stepline.operators.metrics import r6, read_answers
from stepline.plans import oracle as O
from stepline.plans import views as V
from stepline.plans.registry import query
from stepline.sources.tables import table


def _docs(spark, folder):
    return table(spark, folder, "documents")


def _questions(spark, folder):
    return V.question_rows(V.with_questions(V.steps(spark, folder)))


@query("norm_ws", f"SELECT doc_id, {O.norm('text')} AS text FROM documents")
def norm_ws(spark, folder):
    return _docs(spark, folder).select("doc_id", T.norm_ws("text").alias("text"))


@query("clip", f"SELECT doc_id, {O.clip('text')} AS text FROM documents")
def clip(spark, folder):
    return _docs(spark, folder).select("doc_id", T.clip("text").alias("text"))


@query("norm_goal", f"SELECT doc_id, {O.norm_goal('text')} AS goal FROM documents")
def norm_goal(spark, folder):
    return _docs(spark, folder).select("doc_id", T.norm_goal("text").alias("goal"))


_GOAL = "CASE WHEN doc_id%3=0 THEN ' - Task '||doc_id||': \"'||text||'\"' WHEN doc_id%3=1 THEN '“'||text||'”' ELSE text END"


@query(
    "clean_goal",
    rf"""SELECT doc_id, trim(trim(regexp_replace({O.norm('g')}, '^\s*-?\s*((?i)task\s*\d+\s*:)?\s*', ''), '"''“”'), ' ') AS goal
    FROM (SELECT doc_id, {_GOAL} AS g FROM documents)""",
)
def clean_goal(spark, folder):
    d = _docs(spark, folder)
    g = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" - Task "), F.col("doc_id"), F.lit(': "'), F.col("text"), F.lit('"')))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("“"), F.col("text"), F.lit("”")))
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", T.clean_goal(g).alias("goal"))


@query(
    "escape_delimiters",
    r"""SELECT doc_id, regexp_replace('<|'||lang||'|> '||replace(text,' the ',' <|option_'||doc_id||'|> '), '<\|([A-Za-z0-9_]+)\|>', '<¦\1¦>', 'g') AS text FROM documents""",
)
def escape_delimiters(spark, folder):
    d = _docs(spark, folder)
    marked = F.replace(F.col("text"), F.lit(" the "), F.concat(F.lit(" <|option_"), F.col("doc_id"), F.lit("|> ")))
    t = F.concat(F.lit("<|"), F.col("lang"), F.lit("|> "), marked)
    return d.select("doc_id", T.escape_delimiters(t).alias("text"))


@query("render_json", """SELECT event_id, 'k: '||(props->>'$.k')||chr(10)||'event:'||chr(10)||'  type: '||event_type||chr(10)||'  tags:'||chr(10)||'    - '||user_id||chr(10)||'    - True' AS text FROM events""")
def render_json(spark, folder):
    e = table(spark, folder, "events")
    body = F.concat(
        F.regexp_replace("props", r"\}$", ""),
        F.lit(', "event": {"type": "'),
        F.col("event_type"),
        F.lit('", "tags": ['),
        F.col("user_id"),
        F.lit(", true]}}"),
    )
    return e.select("event_id", prompts.render_json(body).alias("text"))


@query(
    "option_text",
    "SELECT p_partkey, CASE WHEN p_size%3=0 THEN p_name ELSE p_name||': '||p_type END AS text FROM part",
)
def option_text(spark, folder):
    p = table(spark, folder, "part")
    desc = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, "")).otherwise(F.col("p_type"))
    return p.select("p_partkey", T.option_text("p_name", desc).alias("text"))


def _requests(spark, folder):
    """Events as three-question requests: JSON text with a choice, a noul and a score question."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    body = F.format_string(
        '{"operation": {"type": "choice", "instructions": "next for %s", "criteria": {"GO": null, "STOP": "end %s", "WAIT": ""}}, '
        '"ok": {"type": "noul", "instructions": "fine?", "criteria": {"true": "good %s"}}, '
        '"rate": {"type": "score", "instructions": "how?", "criteria": ["low", "mid", "high %s"]}}',
        F.col("event_type"), k, k, k,
    )
    labels = F.format_string(
        '{"operation": "%s", "ok": %s, "rate": %s}',
        F.element_at(F.array(F.lit("GO"), F.lit("STOP"), F.lit("WAIT")), (F.col("event_id") % 3 + 1).cast("int")),
        F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"),
        (F.col("user_id") % 3).cast("string"),
    )
    return e.select(F.col("event_id").alias("step_id"), body.alias("questions"), labels.alias("labels"))


_RQ = """SELECT event_id AS step_id, event_type, user_id, props->>'$.k' AS k FROM events"""
_EXPLODED = """SELECT step_id, 'operation' AS qid, 'choice' AS type, 'next for '||event_type AS instr, 'GO|STOP: end '||k||'|WAIT' AS options, 'GO|STOP|WAIT' AS keys, (step_id%3)::INT AS label FROM r
  UNION ALL SELECT step_id, 'ok', 'noul', 'fine?', 'no|yes: good '||k, 'false|true', (user_id%2=0)::INT FROM r
  UNION ALL SELECT step_id, 'rate', 'score', 'how?', 'low|mid|high '||k, '0|1|2', (user_id%3)::INT FROM r"""


@query("explode_questions", O.sql("", f"SELECT step_id, qid, type, instr, options, keys FROM ({_EXPLODED})", r=_RQ))
def explode_questions(spark, folder):
    q = prompts.explode_questions(_requests(spark, folder), "step_id", "questions")
    return q.select("step_id", "qid", "type", "instr", F.array_join("options", "|").alias("options"), F.array_join("keys", "|").alias("keys"))


@query("label_index", O.sql("", f"SELECT step_id, qid, label FROM ({_EXPLODED})", r=_RQ))
def label_index(spark, folder):
    r = _requests(spark, folder)
    q = prompts.explode_questions(r.withColumn("labels", F.from_json("labels", "map<string,string>")), "step_id", "questions", ["labels"])
    return q.select("step_id", "qid", prompts.label_index("type", "keys", F.try_element_at("labels", "qid")).alias("label"))


_SOFT = """SELECT *, sum(s) OVER (PARTITION BY step_id,qid) AS mass FROM (SELECT *, CASE WHEN step_id%6=0 THEN 0.0::DOUBLE WHEN j%2=0 THEN w ELSE 0.0::DOUBLE END AS s FROM opts)"""


@query(
    "soft_label_align",
    O.sql("opts", "SELECT step_id, qid, j, round(s/mass,6) AS soft FROM x WHERE mass>0", x=_SOFT),
)
def soft_label_align(spark, folder):
    q = _questions(spark, folder)
    # only some options carry a soft label, and one step in six has no weight at all
    pairs = F.map_from_arrays("keys", F.transform("w", lambda w: F.when(F.col("step_id") % 6 == 0, 0.0).otherwise(w)))
    positions = F.map_from_arrays("keys", F.sequence(F.lit(0), F.size("keys") - 1))
    soft = F.map_filter(pairs, lambda k, v: F.try_element_at(positions, k) % 2 == 0)
    out = q.select("step_id", "qid", prob.soft_align("keys", soft).alias("soft")).filter("soft is not null")
    return out.select("step_id", "qid", F.posexplode("soft").alias("j", "soft")).select(
        "step_id", "qid", F.col("j").cast("long").alias("j"), r6(F.col("soft")).alias("soft")
    )


@query(
    "soft_label_mix",
    O.sql("opts", "SELECT step_id, qid, key, round(0.5::DOUBLE*p+CASE WHEN is_gold THEN 0.5::DOUBLE ELSE 0 END,6) AS soft FROM opts"),
)
def soft_label_mix(spark, folder):
    q = _questions(spark, folder).select(
        "step_id", "qid", F.explode(F.map_from_arrays("keys", prob.soft_mix("p", "gold", 0.5))).alias("key", "soft")
    )
    return q.select("step_id", "qid", "key", r6(F.col("soft")).alias("soft"))


@query(
    "softmax_temperature",
    O.sql("opts", "SELECT step_id, qid, j, round(exp(ln(w)/2)/sum(exp(ln(w)/2)) OVER (PARTITION BY step_id,qid),6) AS p FROM opts"),
)
def softmax_temperature(spark, folder):
    q = _questions(spark, folder)
    z = F.transform("w", lambda w: F.log(w))
    return q.select("step_id", "qid", F.posexplode(prob.let(z, lambda v: prob.softmax(v, 2.0))).alias("j", "p")).select(
        "step_id", "qid", F.col("j").cast("long").alias("j"), r6(F.col("p")).alias("p")
    )


@query(
    "pointer_score",
    """SELECT a.vec_id AS question, b.vec_id AS option, round(list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda x: x[1]::DOUBLE*x[2]::DOUBLE))/sqrt(64::DOUBLE),6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id+1 AND a.vec_id+4""",
)
def pointer_score(spark, folder):
    e = table(spark, folder, "embeddings")
    asks = e.select(
        F.col("vec_id").alias("question"), F.col("embedding").alias("q"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 4)).alias("option")
    )
    offers = e.select(F.col("vec_id").alias("option"), F.col("embedding").alias("o"))
    return asks.join(offers, "option").select("question", "option", r6(prob.dot_score("q", "o")).alias("score"))


@query(
    "choice_confidence",
    O.sql("qs", "SELECT step_id, qid, round((conf-1.0::DOUBLE/n_opt)/(1-1.0::DOUBLE/n_opt),6) AS confidence FROM qs"),
)
def choice_confidence(spark, folder):
    return _questions(spark, folder).select("step_id", "qid", r6(prob.choice_confidence("p")).alias("confidence"))


_MODE = """SELECT step_id, qid, sum(p*j) AS level, 1-sum(p*abs(j-m))/(max(n_opt)-1) AS confidence FROM (
  SELECT *, first_value(j) OVER (PARTITION BY step_id,qid ORDER BY p DESC, j) AS m FROM opts) GROUP BY step_id,qid"""


@query("score_confidence", O.sql("opts", f"SELECT step_id, qid, round(confidence,6) AS confidence FROM ({_MODE})"))
def score_confidence(spark, folder):
    return _questions(spark, folder).select("step_id", "qid", r6(prob.score_confidence("p")).alias("confidence"))


@query(
    "answers_from_probs",
    O.sql(
        "qs",
        f"""SELECT step_id, qid, CASE step_id%3 WHEN 0 THEN 'choice' WHEN 1 THEN 'noul' ELSE 'score' END AS type,
        CASE WHEN step_id%3=0 THEN pred END AS choice,
        CASE step_id%3 WHEN 1 THEN round(p1,6) WHEN 2 THEN round(level,6) END AS value,
        CASE step_id%3 WHEN 0 THEN round((conf-1.0::DOUBLE/n_opt)/(1-1.0::DOUBLE/n_opt),6) WHEN 2 THEN round(confidence,6) END AS confidence,
        CASE WHEN step_id%3<>1 THEN n_opt END AS n_probabilities
        FROM qs JOIN m USING (step_id,qid) JOIN (SELECT step_id, qid, p AS p1 FROM opts WHERE j=1) USING (step_id,qid)""",
        m=_MODE,
    ),
)
def answers_from_probs(spark, folder):
    q = _questions(spark, folder)
    kind = F.when(F.col("step_id") % 3 == 0, "choice").when(F.col("step_id") % 3 == 1, "noul").otherwise("score")
    a = q.withColumn("type", kind).withColumn("a", prompts.answer(F.col("type"), F.col("keys"), F.col("p"), digits=6))
    return a.select(
        "step_id", "qid", "type", "a.choice", "a.value", "a.confidence",
        F.when(F.col("type") != "noul", F.size("a.probabilities").cast("long")).alias("n_probabilities"),
    )


@query("read_answer", O.sql("bq", "SELECT step_id, qid, choice, round(conf,6) AS confidence, valid, dist AS distribution FROM bq"))
def read_answer(spark, folder):
    s = V.with_answers(V.with_questions(V.steps(spark, folder))).withColumn("scored", read_answers("answers"))
    return s.select("step_id", F.explode_outer("scored").alias("q")).select(
        "step_id", "q.qid", "q.choice", r6(F.col("q.confidence")).alias("confidence"), "q.valid", "q.distribution"
    )


@query(
    "predicted_answer",
    O.sql(
        "opts",
        """SELECT step_id, CASE step_id%4 WHEN 0 THEN pred WHEN 1 THEN (p1>=0.5)::VARCHAR WHEN 2 THEN lvl::VARCHAR ELSE round_even(level,0)::INT::VARCHAR END AS predicted
        FROM (SELECT step_id, (array_agg(key ORDER BY p DESC,j))[1] AS pred, (array_agg(j ORDER BY p DESC,j))[1] AS lvl,
          max(CASE WHEN j=1 THEN CASE WHEN step_id%8=1 THEN 0.5::DOUBLE ELSE p END END) AS p1, sum(p*j) AS level FROM opts WHERE qid='operation' GROUP BY step_id)""",
    ),
)
def predicted_answer(spark, folder):
    q = _questions(spark, folder).filter("qid = 'operation'")
    sid = F.col("step_id")
    kind = F.when(sid % 4 == 0, "choice").when(sid % 4 == 1, "noul").otherwise("score")
    return q.select(
        "step_id",
        prompts.predicted(
            kind,
            choice=F.col("keys")[F.col("pred")],
            noul=F.when(sid % 8 == 1, 0.5).otherwise(F.col("p")[1]),
            probabilities=F.when(sid % 4 == 2, F.col("p")),
            score=prob.expected_level("p"),
        ).alias("predicted"),
    )


@query(
    "one_hot_smooth",
    O.sql(
        "opts",
        """SELECT step_id, qid, key, CASE WHEN n_opt=1 THEN 1.0::DOUBLE WHEN key=chosen THEN round(1-rest*(n_opt-1),6) ELSE rest END AS p,
        round((CASE WHEN n_opt=1 THEN 1.0::DOUBLE ELSE greatest(round(1-rest*(n_opt-1),6),rest) END-1.0::DOUBLE/n_opt)/(1-1.0::DOUBLE/n_opt),6) AS confidence
        FROM (SELECT *, CASE WHEN qid='operation' THEN operation ELSE '1' END AS chosen, round(0.03::DOUBLE/(n_opt-1),6) AS rest FROM opts)""",
    ),
)
def one_hot_smooth(spark, folder):
    q = _questions(spark, folder)
    # a target question of another operation answers its first key
    chosen = F.when(F.col("qid") == "operation", F.col("operation")).otherwise(F.col("keys")[0])
    a = q.withColumn("h", prob.one_hot_smooth("keys", chosen)).withColumn("confidence", r6(prob.choice_confidence("h")))
    return a.select("step_id", "qid", "confidence", F.explode(F.map_from_arrays("keys", "h")).alias("key", "p"))


def _decided(spark, folder):
    """A teacher's operation and target, some of them not on offer."""
    s = V.steps(spark, folder)
    sid, k = F.col("step_id"), F.col("k")
    n_targets = 2 + sid % 7
    return s.select(
        "step_id",
        F.array(*[F.lit(o) for o in V.OPERATIONS]).alias("offered"),
        F.when(sid % 13 == 0, "FLY").otherwise(F.col("operation")).alias("operation"),
        (k % 10).cast("string").alias("target"),
        F.when(sid % 2 == 0, F.transform(F.sequence(F.lit(1).cast("long"), n_targets), lambda i: i.cast("string"))).alias("click_targets"),
    )


@query(
    "valid_decision",
    O.sql(
        "steps",
        """SELECT step_id, CASE WHEN ok THEN op ELSE 'BLOCKED' END AS operation, CASE WHEN ok AND op='CLICK' AND step_id%2=0 THEN t END AS target, ok AS valid FROM (
        SELECT *, op<>'FLY' AND (op<>'CLICK' OR step_id%2<>0 OR t::INT BETWEEN 1 AND 2+step_id%7) AS ok FROM (
        SELECT step_id, CASE WHEN step_id%13=0 THEN 'FLY' ELSE operation END AS op, (k%10)::VARCHAR AS t FROM steps))""",
    ),
)
def valid_decision(spark, folder):
    d = _decided(spark, folder)
    questions = F.create_map(F.lit("click_target"), F.col("click_targets"))
    questions = F.map_filter(questions, lambda k, v: v.isNotNull())
    return d.withColumn("d", prompts.valid_decision(F.col("offered"), questions, F.col("operation"), F.col("target"))).select(
        "step_id", "d.operation", "d.target", "d.valid"
    )


@query(
    "executed_choice",
    O.sql(
        "qs",
        """SELECT o.step_id, o.pred AS operation, CASE WHEN o.pred='CLICK' THEN t.pred END AS target FROM (SELECT * FROM qs WHERE qid='operation') o
        LEFT JOIN (SELECT * FROM qs WHERE qid='click_target') t USING (step_id)""",
    ),
)
def executed_choice(spark, folder):
    s = V.with_questions(V.steps(spark, folder))
    answers = F.map_from_entries(F.transform("questions", lambda q: F.struct(q["qid"], q["keys"][q["pred"]])))
    return s.select("step_id", answers.alias("a")).select(
        "step_id",
        F.col("a")["operation"].alias("operation"),
        F.try_element_at("a", F.concat(F.lower(F.col("a")["operation"]), F.lit("_target"))).alias("target"),
    )


@query(
    "kind_of",
    O.sql("qs", "SELECT qid, CASE WHEN qid LIKE '%!_target' ESCAPE '!' THEN 'target' ELSE qid END AS kind, count(*) AS n FROM qs GROUP BY ALL"),
)
def kind_of(spark, folder):
    return _questions(spark, folder).groupBy("qid", T.kind_of("qid").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "argmax_first",
    O.sql("qs", "SELECT step_id, qid, pred FROM qs"),
)
def argmax_first(spark, folder):
    q = _questions(spark, folder)
    return q.select("step_id", "qid", F.col("keys")[prob.argmax_first("p")].alias("pred"))


# ---- actions, prompts, replies

def _reprs(spark, folder):
    t = T.norm_ws("text")
    line = (
        F.when(F.col("role") == "user", F.concat(F.lit("[textbox]  "), t, F.lit(" -> TYPE: "), t))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("[combobox]  "), t, F.lit(" -> SELECT: "), F.col("role")))
        .when(F.col("role") == "assistant", F.concat(F.lit("[button]  "), t, F.lit(" -> CLICK")))
        .otherwise(t)
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", line.alias("line"))


_REPRS = f"""SELECT conv_id, turn, role, t, CASE WHEN role='user' THEN '[textbox]  '||t||' -> TYPE: '||t WHEN turn%4=1 THEN '[combobox]  '||t||' -> SELECT: '||role
  WHEN role='assistant' THEN '[button]  '||t||' -> CLICK' ELSE t END AS line FROM (SELECT *, {O.norm('text')} AS t FROM conversations)"""
_PARSED = f"""SELECT conv_id, turn, CASE WHEN role='user' OR turn%4=1 OR role='assistant' THEN
   CASE WHEN role='user' THEN 'fill' WHEN turn%4=1 THEN 'select' ELSE 'click' END END AS kind,
   CASE WHEN role<>'user' AND turn%4=1 THEN {O.clip('t')}||' → '||role ELSE {O.clip('t')} END AS action,
   CASE WHEN role='user' THEN t END AS text FROM r"""


@query("parse_action_repr", O.sql("", "SELECT conv_id, turn, action, kind, text FROM p WHERE kind IS NOT NULL", r=_REPRS, p=_PARSED))
def parse_action_repr(spark, folder):
    r = _reprs(spark, folder).withColumn("e", A.parse_action_line("line")).filter("e is not null")
    return r.select("conv_id", "turn", "e.action", "e.kind", "e.text")


_LAST10 = "ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"


@query(
    "recent_actions",
    O.sql(
        "",
        f"""SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_filter(raw_first, lambda x: x IS NOT NULL), lambda x: x), '|'),'') AS raw_first,
        coalesce(array_to_string(kept[greatest(1,len(kept)-9):], '|'),'') AS parse_first FROM (
        SELECT conv_id, turn, array_agg(e) OVER (PARTITION BY conv_id ORDER BY turn {_LAST10}) AS raw_first,
        array_agg(e) FILTER (WHERE e IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM e)""",
        r=_REPRS,
        p=_PARSED,
        e="SELECT conv_id, turn, kind||':'||action||':'||coalesce(text,'-') AS e FROM p",
    ),
)
def recent_actions(spark, folder):
    from stepline.operators.history import history_before

    h = history_before(_reprs(spark, folder).withColumn("e", A.parse_action_line("line")), ["conv_id"], "turn", "e")

    def shown(c):
        one = lambda x: F.concat(x["kind"], F.lit(":"), x["action"], F.lit(":"), F.coalesce(x["text"], F.lit("-")))
        return F.array_join(F.transform(c, one), "|")

    return h.select("conv_id", "turn", shown("raw_first").alias("raw_first"), shown("parse_first").alias("parse_first"))


def _prompts(spark, folder):
    """Recorded prompts and replies over the conversations."""
    t = T.norm_ws("text")
    tree = F.concat(F.lit("RootWebArea 'x', url='u'\n\t[3] link '"), F.col("role"), F.lit("'"))
    prompt = F.concat(
        F.lit("OBSERVATION: old\nOBSERVATION:\n"), tree, F.lit("\nURL: http://h/"), F.col("conv_id"), F.lit(" \nOBJECTIVE: "), t,
        F.lit("\nPREVIOUS ACTIONS:\n1: None\n 2: click [3] where [3] is "), F.col("role"), F.lit("\n\n<|eot_id|>tail"),
    )
    i = F.col("turn") % 6
    act = (
        F.when(i == 0, F.concat(F.lit("click ["), F.col("conv_id"), F.lit("]")))
        .when(i == 1, F.concat(F.lit("type ["), F.col("conv_id"), F.lit("] ["), t, F.lit("] [1]")))
        .when(i == 2, "scroll [up]")
        .when(i == 3, F.concat(F.lit("stop ["), F.when(F.col("conv_id") % 2 == 0, "n/a").otherwise(t), F.lit("]")))
        .when(i == 4, "goto [http://x]")
    )
    reply = F.when(i == 5, t).otherwise(F.concat(F.lit("First ```note``` then ```"), act, F.lit("``` end")))
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", t.alias("t"), prompt.alias("prompt"), reply.alias("reply"))


@query(
    "parse_prompt",
    f"""SELECT conv_id, turn, chr(10)||'RootWebArea ''x'', url=''u'''||chr(10)||chr(9)||'[3] link '''||role||'''' AS tree, 'http://h/'||conv_id AS url,
    {O.norm('text')} AS objective, '1: None|2: click [3] where [3] is '||role AS history FROM conversations""",
)
def parse_prompt(spark, folder):
    p = _prompts(spark, folder).withColumn("p", A.parse_prompt("prompt"))
    return p.select("conv_id", "turn", "p.tree", "p.url", "p.objective", F.array_join("p.history", "|").alias("history"))


_REPLY = f"""SELECT conv_id, turn, CASE turn%6 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'TYPE_TEXT' WHEN 2 THEN 'SCROLL' WHEN 3 THEN 'STOP' END AS kind,
  CASE turn%6 WHEN 0 THEN conv_id::VARCHAR WHEN 1 THEN conv_id::VARCHAR WHEN 2 THEN 'up' WHEN 3 THEN CASE WHEN conv_id%2=0 THEN 'n/a' ELSE {O.norm('text')} END END AS first,
  CASE turn%6 WHEN 1 THEN {O.norm('text')} END AS second FROM conversations"""


@query("parse_action", f"SELECT * FROM ({_REPLY}) WHERE kind IS NOT NULL")
def parse_action(spark, folder):
    p = _prompts(spark, folder).withColumn("a", A.parse_reply("reply")).filter("a is not null")
    return p.select("conv_id", "turn", "a.kind", F.element_at("a.args", 1).alias("first"), F.try_element_at("a.args", F.lit(2)).alias("second"))


@query(
    "stop_classify",
    f"""SELECT conv_id, turn, CASE WHEN kind='STOP' THEN CASE WHEN upper(first) IN ('N/A','NA','') THEN 'BLOCKED' ELSE 'DONE' END
    WHEN kind='SCROLL' THEN 'SCROLL_UP' ELSE kind END AS operation FROM ({_REPLY}) WHERE kind IS NOT NULL""",
)
def stop_classify(spark, folder):
    p = _prompts(spark, folder).withColumn("a", A.parse_reply("reply")).filter("a is not null")
    return p.select("conv_id", "turn", A.reply_operation(F.col("a")).alias("operation"))


@query(
    "parse_verdict",
    "SELECT doc_id, doc_id%4=0 AS done, lang AS reason FROM documents WHERE doc_id%4 IN (0,1)",
)
def parse_verdict(spark, folder):
    d = _docs(spark, folder)
    body = F.to_json(F.struct((F.col("doc_id") % 4 == 0).alias("done"), F.col("lang").alias("reason")))
    reply = (
        F.when(F.col("doc_id") % 4 <= 1, F.concat(F.lit("Sure:\n"), body, F.lit("\nok")))
        .when(F.col("doc_id") % 4 == 2, F.lit('{"done": "true", "reason": "text"}'))
        .otherwise(F.translate("text", "{}", "  "))
    )
    v = d.select("doc_id", A.parse_verdict(reply).alias("v")).filter("v is not null")
    return v.select("doc_id", "v.done", "v.reason")


@query("operation_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'signup' THEN 'TYPE_TEXT' WHEN 'view' THEN 'CLICK' WHEN 'purchase' THEN 'SELECT' END AS operation FROM events")
def operation_map(spark, folder):
    raw = V.lookup({"click": "click", "signup": "paste", "view": "hover", "purchase": "select", "error": "drag"}, F.col("event_type"))
    return table(spark, folder, "events").select("event_id", A.mapped(A.TRACE_OPERATIONS, raw).alias("operation"))


@query(
    "option_matches",
    "SELECT p_partkey, lower(p_name)='red ring' OR lower(p_type)='red ring' AS matches FROM part",
)
def option_matches(spark, folder):
    p = table(spark, folder, "part")
    return p.select("p_partkey", T.option_matches(F.upper("p_name"), "p_type", F.lit("  Red\tRING ")).alias("matches"))


@query(
    "fallback_label",
    "SELECT event_id, CASE WHEN user_id%3=0 THEN event_type WHEN user_id%3=1 THEN 'k '||(props->>'$.k') ELSE 'element' END AS label FROM events",
)
def fallback_label(spark, folder):
    e = table(spark, folder, "events")
    attrs = F.when(
        F.col("user_id") % 3 == 1, F.format_string('{"data": {"aria-label": "k %s"}}', F.get_json_object("props", "$.k"))
    ).otherwise("{}")
    value = F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise("")
    return e.select("event_id", T.fallback_label(value, attrs).alias("label"))


@query("hostname", "SELECT page_id, CASE WHEN page_id%5=0 THEN 'site-'||page_id ELSE lower(regexp_extract(url,'^https?://([^/:?#]+)',1)) END AS website FROM pages")
def hostname(spark, folder):
    p = table(spark, folder, "pages")
    site = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("site-"), F.col("page_id")))
    return p.select("page_id", T.hostname(site, "url").alias("website"))


@query(
    "row_id",
    O.sql("steps", """SELECT step_id, substr(sha1('["'||props_esc||'",{"operation":"'||operation||'"}]'),1,16) AS id FROM (SELECT *, replace(props,'"','\\"') AS props_esc FROM steps)"""),
)
def row_id(spark, folder):
    s = V.steps(spark, folder)
    request = F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    labels = F.to_json(F.struct("operation"))
    return s.select("step_id", prompts.row_id(request, labels).alias("id"))


@query(
    "luhn",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, list_sum(list_transform(range(0,length(n)), lambda i:
      CASE WHEN i%2=0 THEN substr(n,i+1,1)::INT WHEN substr(n,i+1,1)::INT>4 THEN 2*substr(n,i+1,1)::INT-9 ELSE 2*substr(n,i+1,1)::INT END))%10=0 AS valid
    FROM (SELECT *, reverse(l_orderkey::VARCHAR||l_partkey||l_suppkey||l_linenumber) AS n FROM lineitem)""",
)
def luhn(spark, folder):
    li = table(spark, folder, "lineitem")
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return li.select(*key, P.luhn(F.concat(*key)).alias("valid"))


@query(
    "mask_value",
    r"""SELECT doc_id, regexp_replace(regexp_replace(h,'\p{L}','x','g'),'\p{Nd}','0','g')||regexp_replace(t,'\p{L}','x','g') AS masked FROM (
    SELECT doc_id, regexp_extract(s,'(?s)^(.*?)((?:\p{Nd}[^\p{Nd}]*){0,2})$',1) AS h, regexp_extract(s,'(?s)^(.*?)((?:\p{Nd}[^\p{Nd}]*){0,2})$',2) AS t FROM (
    SELECT doc_id, substring('id '||doc_id||'-'||n_chars||' '||text,1,80) AS s FROM documents))""",
)
def mask_value(spark, folder):
    d = _docs(spark, folder)
    s = F.concat(F.lit("id "), F.col("doc_id"), F.lit("-"), F.col("n_chars"), F.lit(" "), F.col("text"))
    return d.select("doc_id", P.mask(s).alias("masked"))

"""Registered queries: personal data and secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepline.functions import privacy as P
from stepline.operators import privacy as R
from stepline.operators.ordering import first_per_group
from stepline.plans import oracle as O
from stepline.plans.registry import query
from stepline.session import materialize
from stepline.sources.tables import table

# the caller brings the list of first names that count as a person's name
NAMES = ["james", "mary", "robert", "linda", "alex"]

# the detectors without look-around, for the oracle: a mark behind every character that can
# not belong to an address keeps neighbours apart
_EMAIL_RE2 = r"(^|[^\p{L}\p{N}_.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})($|[^\p{L}\p{N}_-])"
_MARKED = r"regexp_replace({t},'([^\p{{L}}\p{{N}}_.+%@-])','\1'||chr(3),'g')"


def _emails(t: str) -> str:
    return f"regexp_extract_all({_MARKED.format(t=t)},'{_EMAIL_RE2}',2)"


def _mask(t: str) -> str:
    cut = r"(?s)^(.*?)((?:\p{Nd}[^\p{Nd}]*){0,2})$"
    return (
        rf"regexp_replace(regexp_replace(regexp_extract(substring({t},1,80),'{cut}',1),'\p{{L}}','x','g'),'\p{{Nd}}','0','g')"
        rf"||regexp_replace(regexp_extract(substring({t},1,80),'{cut}',2),'\p{{L}}','x','g')"
    )


def _docs(spark, folder):
    return table(spark, folder, "documents")


_MAILS = f"SELECT doc_id, source, generate_subscripts(e,1) AS i, unnest(e) AS email FROM (SELECT doc_id, source, {_emails('text')} AS e FROM documents) WHERE len(e)>0"


def _email_rows(spark, folder):
    d = _docs(spark, folder).select("doc_id", "source", "text", F.posexplode_outer(P.detect(F.col("text"), P.EMAIL)).alias("i", "s"))
    return d.filter("s is not null").select("doc_id", "source", "text", (F.col("i") + 1).cast("long").alias("i"), F.col("s.text").alias("email"), "s.start", "s.end")


@query("pii_email", O.sql("", "SELECT doc_id, i, email FROM m", m=_MAILS))
def pii_email(spark, folder):
    return _email_rows(spark, folder).select("doc_id", "i", "email")


# The detectors again for an engine without look-around: a pattern is held against the text from
# every place on where a match may begin, the character before is looked at by itself, and the one
# behind is part of the pattern. Of matches that overlap the first counts.
_WORD = r"\pL\pM\pN_"
_PHONE_1 = r"^((?:\+?1[\s.-])?(?:\([0-9]{3}\)\s?[0-9]{3}[-.][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}))(?:[^0-9.]|$)"
_PHONE_2 = r"^(\+[0-9]{1,3}(?:[\s.-]?[0-9]{2,4}){3,5})(?:[^0-9.]|$)"
_CARD_2 = r"^([0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{13,19})(?:[^0-9.,]|$)"
_SSN_2 = r"^([0-9]{3}-[0-9]{2}-[0-9]{4})(?:[^0-9-]|$)"
_MAIL_2 = rf"^([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})(?:[^{_WORD}-]|$)"
_LUHN = """list_sum(list_transform(range(1, length(d)+1), lambda k: CASE WHEN k%2=1 THEN substr(reverse(d),k,1)::INT
  WHEN substr(reverse(d),k,1)::INT>4 THEN 2*substr(reverse(d),k,1)::INT-9 ELSE 2*substr(reverse(d),k,1)::INT END))%10=0"""
SECRET_RE2 = P.SECRET.removeprefix("(?U)")


def found_sql(source: str) -> str:
    """(id, category, start, m) of all findings in the texts of a relation (id, text); start counts from 0."""

    def first(rows: str) -> str:
        return f"""SELECT id, text, i, m FROM (SELECT *, coalesce(max(i+length(m)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS busy FROM ({rows}) WHERE m<>'') WHERE busy<=i"""

    def at(starts: str, texts: str, width: int) -> str:
        return f"""SELECT id, text, i, CASE WHEN i=1 THEN '' ELSE substring(text,i-1,1) END AS b, substring(text,i,{width}) AS w FROM (
          SELECT id, text, unnest(range(1,length(text)+1)) AS i FROM {source} WHERE regexp_matches(text,'{texts}')) WHERE regexp_matches(substring(text,i,1),'{starts}')"""

    phone = f"""SELECT id, text, i, CASE WHEN NOT regexp_matches(b,'[{_WORD}+.]') AND regexp_matches(w,'{_PHONE_1}') THEN regexp_extract(w,'{_PHONE_1}',1)
      WHEN NOT regexp_matches(b,'[{_WORD}+]') THEN regexp_extract(w,'{_PHONE_2}',1) ELSE '' END AS m FROM ({at('[0-9+(]', '[0-9]{2}', 64)})"""
    card = f"SELECT id, text, i, regexp_extract(w,'{_CARD_2}',1) AS m FROM ({at('[0-9]', '[0-9]{4}', 64)}) WHERE NOT regexp_matches(b,'[0-9.,-]')"
    ssn = f"SELECT id, text, i, regexp_extract(w,'{_SSN_2}',1) AS m FROM ({at('[0-9]', '[0-9]-[0-9]', 64)}) WHERE NOT regexp_matches(b,'[0-9.-]')"
    mail = f"SELECT id, text, i, regexp_extract(w,'{_MAIL_2}',1) AS m FROM ({at('[A-Za-z0-9._%+-]', '@', 300)}) WHERE NOT regexp_matches(b,'[{_WORD}.+-]')"
    before = lambda n: f"substring(text, greatest(1,i-{n}), least({n},i-1))"
    is_card = f"""length(d) BETWEEN 13 AND 19 AND {_LUHN} AND d<>repeat(left(d,1),length(d)) AND NOT regexp_matches(m,'{P.YEARS_ONLY}')
      AND (regexp_matches(m,'[ -]') OR regexp_matches({before(40)},'{P.CARD_CONTEXT}'))"""
    return f"""SELECT id, 'phone' AS category, i-1 AS start, m FROM ({first(phone)}) UNION ALL SELECT id, 'email', i-1, m FROM ({first(mail)})
      UNION ALL SELECT id, 'ssn', i-1, m FROM ({first(ssn)}) WHERE NOT regexp_matches({before(30)},'{P.NOT_SSN}')
      UNION ALL SELECT id, 'card', i-1, m FROM (SELECT *, regexp_replace(m,'[^0-9]','','g') AS d FROM ({first(card)})) WHERE {is_card}
      UNION ALL SELECT id, 'secret', strpos(text,m)-1, m FROM (SELECT id, text, unnest(regexp_extract_all(text,'{SECRET_RE2}')) AS m FROM {source})"""


_DOC_TEXTS = "SELECT doc_id AS id, text FROM documents"


@query("pii_find", O.sql("", f"SELECT id AS doc_id, category, start::INT AS start, (start+length(m))::INT AS \"end\", {_mask('m')} AS masked FROM f", dt=_DOC_TEXTS, f=found_sql("dt")))
def pii_find(spark, folder):
    d = _docs(spark, folder).select("doc_id", F.explode_outer(P.find(F.col("text"))).alias("f")).filter("f is not null")
    return d.select("doc_id", "f.category", "f.start", "f.end", P.mask("f.text").alias("masked"))


@query(
    "match_context",
    r"""SELECT doc_id, trim(regexp_replace(substring(t,greatest(1,s-30),least(30,s-1))||'['||"""
    + _mask("n")
    + rf"""||']'||substring(t,s+length(n),30),'{O.SPACES}',' ','g'),' ') AS context FROM (
    SELECT doc_id, text||' no '||doc_id||'7.' AS t, regexp_extract(text||' no '||doc_id||'7.','[0-9]{{2,}}') AS n, strpos(text||' no '||doc_id||'7.', regexp_extract(text||' no '||doc_id||'7.','[0-9]{{2,}}')) AS s FROM documents)""",
)
def match_context(spark, folder):
    t = F.concat(F.col("text"), F.lit(" no "), F.col("doc_id"), F.lit("7."))
    d = _docs(spark, folder).select("doc_id", t.alias("t")).withColumn("s", F.element_at(P.spans(F.col("t"), "[0-9]{2,}"), 1))
    return d.select("doc_id", P.context(F.col("t"), F.col("s.start"), F.col("s.end")).alias("context"))


# the page of a step is its document, with some numbers put in front by rule
PHONE_LINE, SSN_LINE, CARD_NUMBER = "Call 212-555-0187 today. ", "My number is 078-05-1121 and so on. ", "4111 1111 1111 1111"
_PAGE_SQL = f"CASE WHEN doc_id%13=0 THEN '{PHONE_LINE}' ELSE '' END||CASE WHEN doc_id%23=0 THEN '{SSN_LINE}' ELSE '' END||text"


def browser_steps(spark, folder):
    """One step per document: its text as the page, form values typed from it."""
    d = _docs(spark, folder)
    i = F.col("doc_id")
    page = F.concat(F.when(i % 13 == 0, PHONE_LINE).otherwise(""), F.when(i % 23 == 0, SSN_LINE).otherwise(""), F.col("text"))
    mail = F.concat(F.lit("user"), i, F.lit("@mail.example.com"))
    element = lambda label, value, op: F.struct(
        F.lit("textbox").alias("role"), F.lit(label).alias("label"), value.cast("string").alias("value"), F.lit("1").alias("index"), F.array(F.lit(op)).alias("operations"),
        F.lit(None).cast("array<struct<index:string,label:string,value:string>>").alias("options"),
    )
    elements = F.array_compact(
        F.array(
            F.when(i % 3 == 0, element("E-mail", mail, "TYPE_TEXT")),
            F.when(i % 5 == 0, element("Password", F.concat(F.lit("hunter"), i), "TYPE_TEXT")),
            F.when(i % 4 == 0, element("Country", F.col("lang"), "SELECT")),
            F.when(i % 19 == 0, element("Card number", F.lit(CARD_NUMBER), "TYPE_TEXT")),
        )
    )
    action = lambda a, k, t: F.struct(F.lit(a).alias("action"), F.lit(k).alias("kind"), t.cast("string").alias("text"), F.lit(None).cast("boolean").alias("page_changed"))
    actions = F.array_compact(
        F.array(
            F.when(i % 7 == 0, action("Your name", "fill", F.lit("Mary Poppins"))),
            F.when(i % 2 == 0, action("Search", "click", F.lit(None))),
        )
    )
    url = F.concat(F.lit("http://h.example.com/?d="), i, F.when(i % 6 == 0, F.concat(F.lit("&token=abcdefghijkl"), i)).otherwise(""))
    state = F.struct(
        F.struct(url.alias("url"), F.col("source").alias("title"), page.alias("text")).alias("page"), elements.alias("elements"), actions.alias("recent_actions")
    )
    goal = F.when(i % 9 == 0, F.concat(F.lit("Write to "), F.upper(mail))).otherwise("Read the page")
    op = F.when(i % 10 == 0, "DONE").otherwise("CLICK")
    return d.select(
        F.col("source").alias("config"), F.when(i % 5 == 0, "validation").otherwise("train").alias("split"), i.alias("id"),
        goal.alias("goal"), F.when(i % 8 == 0, "because of the page").alias("reason"), op.alias("operation"), state.alias("state"),
    )


STEPS_SQL = f"""SELECT doc_id AS id, source AS config, lang, CASE WHEN doc_id%5=0 THEN 'validation' ELSE 'train' END AS split, {_PAGE_SQL} AS text,
  'user'||doc_id||'@mail.example.com' AS mail, 'http://h.example.com/?d='||doc_id||CASE WHEN doc_id%6=0 THEN '&token=abcdefghijkl'||doc_id ELSE '' END AS url,
  CASE WHEN doc_id%9=0 THEN 'Write to '||upper('user'||doc_id||'@mail.example.com') ELSE 'Read the page' END AS goal,
  CASE WHEN doc_id%8=0 THEN 'because of the page' END AS reason FROM documents"""
_FIELDS = """SELECT id, 'url' AS field, url AS text, false AS typed, '' AS label FROM st UNION ALL SELECT id, 'page_text', text, false, '' FROM st
  UNION ALL SELECT id, 'typed', 'Mary Poppins', true, 'Your name' FROM st WHERE id%7=0 UNION ALL SELECT id, 'labels', 'Your name', false, '' FROM st WHERE id%7=0
  UNION ALL SELECT id, 'labels', 'Search', false, '' FROM st WHERE id%2=0 UNION ALL SELECT id, 'labels', 'E-mail', false, '' FROM st WHERE id%3=0
  UNION ALL SELECT id, 'labels', 'Password', false, '' FROM st WHERE id%5=0 UNION ALL SELECT id, 'labels', 'Country', false, '' FROM st WHERE id%4=0
  UNION ALL SELECT id, 'labels', 'Card number', false, '' FROM st WHERE id%19=0 UNION ALL SELECT id, 'typed', '4111 1111 1111 1111', true, 'Card number' FROM st WHERE id%19=0
  UNION ALL SELECT id, 'typed', mail, true, 'E-mail' FROM st WHERE id%3=0 UNION ALL SELECT id, 'typed', 'hunter'||id, true, 'Password' FROM st WHERE id%5=0
  UNION ALL SELECT id, 'goal', goal, false, '' FROM st UNION ALL SELECT id, 'labels', reason, false, '' FROM st WHERE reason IS NOT NULL"""


@query("scan_fields", O.sql("", _FIELDS, st=STEPS_SQL))
def scan_fields(spark, folder):
    s = browser_steps(spark, folder)
    f = F.explode_outer(R.scan_fields(F.col("goal"), F.col("reason"), F.col("state"))).alias("f")
    return s.select("id", f).select("id", "f.*")


# what the pages hold, and what the derived steps hold by rule
_FOUND = f"""SELECT id, 'page_text' AS field, category FROM ({found_sql('st')})
  UNION ALL SELECT id, 'typed', 'card' FROM st WHERE id%19=0
  UNION ALL SELECT id, 'url', 'secret' FROM st WHERE id%6=0
  UNION ALL SELECT id, 'typed', 'name' FROM st WHERE id%7=0
  UNION ALL SELECT id, 'typed', CASE WHEN id%9=0 THEN 'email_from_goal' ELSE 'email' END FROM st WHERE id%3=0
  UNION ALL SELECT id, 'typed', 'password_value' FROM st WHERE id%5=0
  UNION ALL SELECT id, 'goal', 'email' FROM st WHERE id%9=0"""


def _found(spark, folder):
    return R.scan(browser_steps(spark, folder), NAMES)


@query("scan_row", O.sql("", "SELECT id, field, category, count(*) AS n FROM fo GROUP BY ALL", st=STEPS_SQL, fo=_FOUND))
def scan_row(spark, folder):
    return _found(spark, folder).groupBy("id", "field", "category").agg(F.count("*").alias("n"))


@query(
    "pii_report",
    O.sql(
        "",
        """SELECT 'matches' AS part, config, field||':'||category AS item, count(*) AS n FROM fo JOIN st USING (id) GROUP BY ALL
        UNION ALL SELECT 'rows_flagged', config, category, count(DISTINCT id) FROM fo JOIN st USING (id) GROUP BY ALL""",
        st=STEPS_SQL,
        fo=_FOUND,
    ),
)
def pii_report(spark, folder):
    return R.report(_found(spark, folder))


@query("pii_row_ids", O.sql("", "SELECT DISTINCT category, config||'/'||split||'/'||id AS row FROM fo JOIN st USING (id)", st=STEPS_SQL, fo=_FOUND))
def pii_row_ids(spark, folder):
    return R.flagged_rows(_found(spark, folder))


@query(
    "first_n_examples",
    O.sql("", f"SELECT source, doc_id, i, {_mask('email')} AS masked FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS rn FROM m) WHERE rn<=5", m=_MAILS),
)
def first_n_examples(spark, folder):
    e = first_per_group(_email_rows(spark, folder).select("source", "doc_id", "i", "email"), ["source"], [F.col("doc_id"), F.col("i")], 5)
    return e.select("source", "doc_id", "i", P.mask("email").alias("masked"))


_RULES = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in P.POLICY.items())


@query(
    "redaction_policy",
    O.sql("", f"SELECT category, count(*) AS n, CASE CASE WHEN category LIKE '%!_from!_goal' ESCAPE '!' THEN '*_from_goal' ELSE category END {_RULES} END AS rule FROM fo GROUP BY category", st=STEPS_SQL, fo=_FOUND),
)
def redaction_policy(spark, folder):
    return _found(spark, folder).groupBy("category").agg(F.count("*").alias("n")).withColumn("rule", R.policy_of(F.col("category")))


def _context(text, start, m):
    """A masked match between its neighbours, as SQL; start counts from 0."""
    return f"trim(regexp_replace(substring({text},greatest(1,{start}-29),least(30,{start}))||'['||{_mask(m)}||']'||substring({text},{start}+length({m})+1,30),'{O.SPACES}',' ','g'),' ')"


_TOKEN = "'abcdefghijkl'||id"
_EXAMPLES = f"""SELECT id, 'page_text' AS field, category, {_context('text', 'start', 'm')} AS context FROM (SELECT f.id, f.category, f.start, f.m, st.text FROM ({found_sql('st')}) f JOIN st ON st.id=f.id)
  UNION ALL SELECT id, 'typed', 'card', {_context(f"'{CARD_NUMBER}'", '0', f"'{CARD_NUMBER}'")} FROM st WHERE id%19=0
  UNION ALL SELECT id, 'url', 'secret', {_context('url', f"(strpos(url,{_TOKEN})-1)", f"({_TOKEN})")} FROM st WHERE id%6=0
  UNION ALL SELECT id, 'typed', 'name', 'Your name: ['||{_mask("'Mary Poppins'")}||']' FROM st WHERE id%7=0
  UNION ALL SELECT id, 'typed', CASE WHEN id%9=0 THEN 'email_from_goal' ELSE 'email' END, {_context('mail', '0', 'mail')} FROM st WHERE id%3=0
  UNION ALL SELECT id, 'typed', 'password_value', 'Password: ['||{_mask("('hunter'||id)")}||']' FROM st WHERE id%5=0
  UNION ALL SELECT id, 'goal', 'email', {_context('goal', '9', '(upper(mail))')} FROM st WHERE id%9=0"""
_SCAN = f"""SELECT 'matches' AS part, config, field||':'||category AS item, count(*) AS n, NULL::VARCHAR AS note FROM fd JOIN st USING (id) GROUP BY ALL
  UNION ALL SELECT 'rows_flagged', config, category, count(DISTINCT id), NULL FROM fd JOIN st USING (id) GROUP BY ALL
  UNION ALL SELECT 'rows_scanned', config, '', count(*), NULL FROM st GROUP BY ALL
  UNION ALL SELECT 'example', config, field||':'||category, rn, context FROM (SELECT config, field, category, context,
    row_number() OVER (PARTITION BY field, category ORDER BY config, split, id, context) AS rn FROM fd JOIN st USING (id)) WHERE rn<=5
  UNION ALL SELECT 'rule', '', category, NULL, CASE CASE WHEN category LIKE '%!_from!_goal' ESCAPE '!' THEN '*_from_goal' ELSE category END {_RULES} END FROM (SELECT DISTINCT category FROM fd)"""


@query("job_pii_scan", O.sql("", _SCAN, st=STEPS_SQL, fd=_EXAMPLES))
def job_pii_scan(spark, folder):
    """The whole report in long form: matches, flagged rows, rows scanned, examples with the proposed rule.

    The published folder also holds the bench, a copy of test rows, which is not scanned again.
    """
    steps = browser_steps(spark, folder)
    copy = steps.where(F.col("id") % 10 == 0).withColumn("config", F.lit(R.BENCH))
    s = R.without_copies(steps.unionByName(copy))
    found = materialize(R.scan(s, NAMES), "findings")
    counts = R.report(found).select("part", "config", "item", "n", F.lit(None).cast("string").alias("note"))
    scanned = s.groupBy("config").agg(F.count("*").alias("n")).select(F.lit("rows_scanned").alias("part"), "config", F.lit("").alias("item"), "n", F.lit(None).cast("string").alias("note"))
    ex = R.examples(found).select(F.lit("example").alias("part"), "config", F.concat_ws(":", "field", "category").alias("item"), F.col("_rn").cast("long").alias("n"), F.col("context").alias("note"))
    rules = found.select("category").distinct().select(F.lit("rule").alias("part"), F.lit("").alias("config"), F.col("category").alias("item"), F.lit(None).cast("long").alias("n"), R.policy_of(F.col("category")).alias("note"))
    return counts.unionByName(scanned).unionByName(ex).unionByName(rules)


_LEAKY = "text||' '||source||'@x.org?token=0123456789abcdef'"
_CLEAN = rf"replace(regexp_replace({_MARKED.format(t=_LEAKY)},'{_EMAIL_RE2}','\1<email>\3','g'),chr(3),'')"


@query("redact_email", f"SELECT doc_id, replace({_CLEAN},'?token=0123456789abcdef','?token=<redacted>') AS text FROM documents")
def redact_email(spark, folder):
    t = F.concat(F.col("text"), F.lit(" "), F.col("source"), F.lit("@x.org?token=0123456789abcdef"))
    return _docs(spark, folder).select("doc_id", P.redact_free(t, F.lit("")).alias("text"))


_URL_SECRET_RE2 = P.URL_SECRET.replace("'", "''")
_SAFE = rf"regexp_replace(regexp_replace(text,'{SECRET_RE2}','<redacted>','g'),'{_URL_SECRET_RE2}','\1<redacted>','g')"
_REDACTED = rf"""SELECT id, config, split, goal, (id%19=0 OR id IN (SELECT id FROM numbers)) AS dropped, CASE WHEN id%6=0 THEN 'http://h.example.com/?d='||id||'&token=<redacted>' ELSE url END AS url,
  replace(regexp_replace({_MARKED.format(t=_SAFE)},'{_EMAIL_RE2}','\1<email>\3','g'),chr(3),'') AS text,
  concat_ws('|', CASE WHEN id%3=0 THEN CASE WHEN id%9=0 THEN mail ELSE 'user@example.com' END END, CASE WHEN id%5=0 THEN '<redacted>' END, CASE WHEN id%4=0 THEN lang END,
    CASE WHEN id%19=0 THEN '{CARD_NUMBER}' END, CASE WHEN id%7=0 THEN 'Alex Doe' END) AS typed FROM st"""


_NUMBERS = f"SELECT id FROM ({found_sql('st')}) WHERE category IN ('card','ssn')"


@query("redact_row", O.sql("", _REDACTED, st=STEPS_SQL, numbers=_NUMBERS))
def redact_row(spark, folder):
    r = R.redact(browser_steps(spark, folder), NAMES)
    values, said = F.transform("state.elements", lambda e: e["value"]), F.transform("state.recent_actions", lambda a: a["text"])
    return r.select(
        "id", "config", "split", "goal", "dropped", F.col("state.page.url").alias("url"), F.col("state.page.text").alias("text"), F.array_join(F.concat(values, said), "|").alias("typed"),
    )

"""The derived relations again, as SQL common table expressions for the oracle."""

from __future__ import annotations

SPACES = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c},''),'{SPACES}',' ','g'),' ')"


def clip(c: str, n: int = 100) -> str:
    return f"(CASE WHEN length({norm(c)})<={n} THEN {norm(c)} ELSE rtrim(substring({norm(c)},1,{n - 1}),' ')||'…' END)"


def norm_goal(c: str) -> str:
    return f"regexp_replace(lower({norm(c)}),'\\.+$','')"


def key(seed: object, *parts: str) -> str:
    return "sha256(" + "||':'||".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]]) + ")"


def unit(hexes: str) -> str:
    return f"(('0x'||substr({hexes},1,13))::BIGINT/4503599627370496.0::DOUBLE)"


def hex_mod(hexes: str, m: int) -> str:
    step = pow(16, 8, m)
    v = "0"
    for i in range(8):
        v = f"(({v}*{step}+('0x'||substr({hexes},{8 * i + 1},8))::BIGINT)%{m})"
    return v


VIEWS = {
    "steps": """SELECT event_id AS step_id, user_id AS session, ts, event_type,
        CASE event_type WHEN 'click' THEN 'CLICK' WHEN 'signup' THEN 'TYPE_TEXT' WHEN 'view' THEN 'SCROLL_DOWN'
          WHEN 'error' THEN 'BLOCKED' WHEN 'purchase' THEN 'DONE' END AS operation,
        's'||(user_id%5) AS subset, (props->>'$.k')::BIGINT AS k, value/1000 AS latency_s, value,
        CASE WHEN event_id%97=0 THEN 'Timeout: x' END AS error, props FROM events""",
    "opt0": """SELECT step_id, subset, operation, k, 'operation' AS qid, j, o AS key,
        ((step_id*(j+3)+k*j)%17+1)::DOUBLE AS w, o=operation AS is_gold, 5 AS n_opt
        FROM steps, (VALUES (0,'CLICK'),(1,'TYPE_TEXT'),(2,'SCROLL_DOWN'),(3,'BLOCKED'),(4,'DONE')) v(j,o)
        UNION ALL
        SELECT step_id, subset, operation, k, 'click_target' AS qid, j, (j+1)::VARCHAR AS key,
        ((step_id*(j+5)+k)%13+1)::DOUBLE AS w, j=step_id%(2+step_id%7) AS is_gold, 2+step_id%7 AS n_opt
        FROM steps, range(0,8) r(j) WHERE operation='CLICK' AND j<2+step_id%7""",
    "opts": """SELECT *, w/sum(w) OVER (PARTITION BY step_id,qid) AS p FROM opt0""",
    "qs": """SELECT step_id, subset, operation, qid, max(n_opt) AS n_opt, max(p) AS conf,
        (array_agg(key ORDER BY p DESC, j))[1] AS pred, max(CASE WHEN is_gold THEN key END) AS gold,
        (array_agg(is_gold ORDER BY p DESC, j))[1] AS correct,
        sum((p-is_gold::INT)*(p-is_gold::INT)) AS brier,
        max(CASE WHEN key='DONE' THEN p END) AS p_done
        FROM opts GROUP BY step_id, subset, operation, qid""",
    "bq": """SELECT q.step_id, q.subset, q.qid, q.gold, s.error, s.latency_s,
        CASE WHEN s.error IS NULL THEN length(s.props)+s.k END AS input_tokens,
        s.error IS NULL AND q.step_id%89<>0 AS valid,
        CASE WHEN s.error IS NULL AND q.step_id%89<>0 THEN q.pred END AS choice,
        s.error IS NULL AND q.step_id%89<>0 AND q.step_id%83<>0 AND q.step_id%79<>0 AS dist,
        CASE WHEN s.error IS NOT NULL OR q.step_id%89=0 THEN 0.0::DOUBLE
             WHEN q.step_id%83=0 OR q.step_id%79=0 THEN 1.0::DOUBLE ELSE q.conf END AS conf,
        (s.error IS NULL AND q.step_id%89<>0 AND q.correct) AS correct,
        CASE WHEN s.error IS NULL AND q.step_id%89<>0 AND q.step_id%83<>0 AND q.step_id%79<>0 THEN q.brier END AS brier
        FROM qs q JOIN steps s USING (step_id)""",
    "episodes": """SELECT user_id AS session, 'task-'||lpad(user_id::VARCHAR,5,'0') AS task,
        CASE user_id%3 WHEN 0 THEN 'walks' WHEN 1 THEN 'flights' ELSE 'wikipedia' END AS source,
        CASE user_id%4 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' WHEN 2 THEN 'error' ELSE 'budget' END AS outcome,
        CASE WHEN user_id%8=2 THEN 'StalePage: x' ELSE '' END AS error, count(*) AS n_events
        FROM events WHERE user_id%11<>0 GROUP BY user_id""",
    "decisions": """SELECT step_id, session, ts, operation,
        CASE WHEN operation='BLOCKED' THEN CASE WHEN step_id%3=0 THEN 'captcha page' ELSE 'loop' END
             ELSE 'go on '||k END AS reason, operation||'|'||(k%20) AS request, k FROM steps""",
    "verdicts": """SELECT DISTINCT user_id AS session, user_id%5<>0 AS judged_done FROM events""",
    "states": """SELECT 'd'||doc_id AS id, text AS state, source FROM documents UNION ALL
        SELECT 'b'||item_id, translate(replace(text,' ','  '),'abcdefghijklmnopqrstuvwxyz','ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'benchmark-copy' FROM benchmark""",
    "nodes": r"""SELECT * REPLACE (CASE tag WHEN 'p' THEN 'span' WHEN 'li' THEN 'em' ELSE tag END AS tag), least(pre+size, n_nodes)-1 AS last, CASE WHEN pre%2=1 THEN pre-1 WHEN pre%4=2 THEN pre-2 WHEN pre%8=4 THEN pre-4 END AS parent,
        """
    + clip("raw")
    + r""" AS label FROM (SELECT *, CASE WHEN pre%8=0 THEN 8 WHEN pre%4=0 THEN 4 WHEN pre%2=0 THEN 2 ELSE 1 END AS size FROM (
        SELECT page_id, url, len(m)::BIGINT AS n_nodes, unnest(range(0,len(m))) AS pre, unnest(m) AS tag, unnest(x) AS raw FROM (
        SELECT page_id, url, regexp_extract_all(html,'<(a|p|li|h1)(?:\s[^>]*)?>([^<]*)',1) AS m,
          regexp_extract_all(html,'<(a|p|li|h1)(?:\s[^>]*)?>([^<]*)',2) AS x FROM pages)))""",
}

NEEDS = {
    "opt0": ["steps"],
    "opts": ["opt0"],
    "qs": ["opts"],
    "bq": ["qs", "steps"],
    "decisions": ["steps"],
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in [*_order(NEEDS.get(n, [])), n]:
            if d not in out:
                out.append(d)
    return out


def sql(views: str, body: str, **extra: str) -> str:
    """``WITH <views, their needs, extra> <body>``."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _order(views.split())] + [f"{n} AS ({b})" for n, b in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body

"""The registered queries in SQL, written apart from the Spark side, on the same tables."""

from __future__ import annotations

import re

from demandweave.checks.standins import DOCUMENT_ROLES, PART_ROLES, WORD_GUARDS, WORDS
from demandweave.plans import quality

_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _hash(company: str, title: str, location: str) -> str:
    return f"upper(sha256({_norm(company)} || '|' || {_norm(title)} || '|' || {_norm(location)}))"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def _source(n: str) -> str:
    return f"(['greenhouse', 'lever', 'ashby', 'arbeitnow'])[cast({n} % 4 + 1 as int)]"


def _at(seconds: str) -> str:
    return f"make_timestamp((cast(1704067200 AS bigint) + {seconds}) * 1000000)"


def _values(rows: list[tuple]) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_DOCUMENT_JOBS = """
    SELECT doc_id AS seq, {source} AS source, cast(doc_id AS varchar) AS source_job_id, lang AS board_token,
           lang AS company, {title} AS title, cast(NULL AS varchar) AS location,
           doc_id % 2 = 0 AS is_remote, text AS description, {at} AS posted_at, documents.source AS origin
    FROM documents"""


def _document_jobs(title: str = "text") -> str:
    return _DOCUMENT_JOBS.format(source=_source("cast(substr(documents.source, 4, 3) AS int)"), title=title, at=_at("doc_id"))


_CHANGED = "CASE WHEN doc_id % 7 = 0 THEN text || ' ii' ELSE text END"


# Named subqueries; each may use those before it.
CTES = {
    "jobs": f"""
    SELECT cast(p_partkey AS varchar) AS job_id, {_source('p_size')} AS source,
           'p' || p_partkey AS source_job_id, lower(p_brand) AS board_token, p_brand AS company,
           p_name AS title, p_type AS location, p_partkey % 3 = 0 AS is_remote,
           p_name || ' ' || p_type AS description, 'https://jobs.example/' || lower(p_brand) AS apply_url,
           CASE WHEN p_size % 7 <> 0 THEN {_at('(p_partkey % 400) * 86400 + (p_partkey % 24) * 3600')} END AS posted_at,
           {_hash('p_brand', 'p_name', 'p_type')} AS dedup_hash,
           {_at('(p_partkey % 90) * 86400')} AS first_seen_at,
           {_at('(p_partkey % 90 + p_size) * 86400')} AS last_seen_at, p_size > 5 AS is_active
    FROM part""",
    "lines": """
    SELECT l_partkey, l_linenumber, l_returnflag, n_name, r_name
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
    "raw_links": """
    SELECT cast(l_partkey AS varchar) AS job_id, n_name AS skill,
           CASE WHEN l_linenumber % 3 <> 0 THEN r_name || l_returnflag END AS category FROM lines""",
    "job_skills": "SELECT DISTINCT cast(l_partkey AS varchar) AS job_id, n_name AS skill, r_name AS category FROM lines",
    "stg_skills": """
    SELECT job_id, skill, category FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id, skill ORDER BY category NULLS LAST) AS rn FROM raw_links
    ) WHERE rn = 1""",
    "demand": """
    SELECT event_type AS role, 'k' || k AS skill, CASE WHEN k % 5 <> 0 THEN 'c' || (k % 5) END AS category,
           snapshot_date, cast(count(*) AS bigint) AS job_count
    FROM (SELECT event_type, cast(json_extract_string(props, '$.k') AS int) AS k, cast(ts AS date) AS snapshot_date
          FROM events) GROUP BY ALL""",
    "runs": """
    SELECT cast(cast(ts AS date) AS varchar) AS run_id, min(ts) AS started_at, max(ts) AS finished_at
    FROM events GROUP BY 1""",
    "roles": "SELECT * FROM (" + _values(PART_ROLES) + ") AS t(role, pattern)",
    "fact": """
    SELECT * FROM (
        SELECT *, lower(title) AS title_lower, row_number() OVER (PARTITION BY dedup_hash ORDER BY job_id) AS rn
        FROM jobs WHERE is_active) WHERE rn = 1""",
    "posting_roles": "SELECT DISTINCT job_id, role FROM fact JOIN roles ON contains(title_lower, pattern)",
    "part_demand": """
    SELECT role, skill, category, cast(count(DISTINCT job_id) AS bigint) AS job_count
    FROM posting_roles JOIN job_skills USING (job_id) GROUP BY role, skill, category""",
    "role_totals": """
    SELECT role, count(DISTINCT dedup_hash) AS role_total
    FROM jobs JOIN roles ON contains(lower(title), pattern) WHERE is_active GROUP BY role""",
    "user_skills": """
    SELECT c_custkey AS user_id, (['Red', 'Fastener', 'Ring', 'Widget'])[cast(c_custkey % 4 + 1 AS int)] AS role,
           CASE WHEN c_acctbal >= 0 THEN n_name END AS skill
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "leaders": """
    SELECT d.*, coalesce(t.role_total, 0) AS role_total,
           CASE WHEN t.role_total > 0 THEN d.job_count / t.role_total ELSE 0.0 END AS share
    FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY job_count DESC, skill, category NULLS LAST) AS place
          FROM part_demand) d LEFT JOIN role_totals t USING (role) WHERE place <= 20""",
    "gap": """
    SELECT u.user_id, l.role, l.role_total, l.skill, l.category, l.job_count, cast(l.share AS double) AS share,
           coalesce(u.skill = l.skill, false) AS have
    FROM user_skills u JOIN leaders l USING (role)""",
    "existing": f"""
    SELECT 'j' || seq AS job_id, source, source_job_id, board_token, company, title, location, is_remote,
           description, '' AS apply_url, posted_at, {_hash('company', 'title', 'location')} AS dedup_hash,
           {_at('0')} AS first_seen_at, {_at('86400')} AS last_seen_at, seq % 11 <> 0 AS is_active
    FROM ({_document_jobs()}) WHERE origin NOT IN ('src3', 'src7')""",
    "fetched": f"""
    SELECT * EXCLUDE (origin) FROM ({_document_jobs(_CHANGED)}) WHERE origin NOT IN ('src5', 'src11')
    UNION ALL
    SELECT * EXCLUDE (origin) REPLACE (seq + 1000000000 AS seq, 'again' AS title) FROM ({_document_jobs()})
    WHERE origin NOT IN ('src5', 'src11') AND board_token = 'es'""",
    "arrivals": f"""
    SELECT *, {_hash('company', 'title', 'location')} AS dedup_hash FROM (
        SELECT *, row_number() OVER (PARTITION BY source, source_job_id ORDER BY seq) AS rn FROM fetched) WHERE rn = 1""",
    "owners": """
    SELECT dedup_hash, arg_min(source, job_id) AS osrc FROM existing WHERE is_active GROUP BY dedup_hash""",
    "marked": """
    SELECT a.*, e.job_id AS old_id, o.osrc FROM arrivals a
    LEFT JOIN existing e USING (source, source_job_id) LEFT JOIN owners o ON o.dedup_hash = a.dedup_hash""",
    "decided": """
    SELECT *, CASE WHEN old_id IS NOT NULL THEN 'update' WHEN own = source THEN 'insert' ELSE 'skip' END AS decision
    FROM (SELECT *, coalesce(
            last_value(CASE WHEN old_id IS NOT NULL THEN source END IGNORE NULLS) OVER (
                PARTITION BY dedup_hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            osrc, first_value(source) OVER (PARTITION BY dedup_hash ORDER BY seq)) AS own FROM marked)""",
    "boards": f"""
    SELECT DISTINCT source, board_token FROM ({_document_jobs()})
    WHERE NOT (source = 'lever' AND board_token = 'fr')""",
}

_AS_OF = "TIMESTAMP '2025-03-01 12:00:00'"


def _reconciled(boards: str = "boards") -> str:
    return f"""
    SELECT coalesce(e.job_id, sha256(f.source || '|' || f.source_job_id)) AS job_id,
           coalesce(e.source, f.source) AS source, coalesce(e.source_job_id, f.source_job_id) AS source_job_id,
           CASE WHEN f.seq IS NULL THEN e.board_token ELSE f.board_token END AS board_token,
           CASE WHEN f.seq IS NULL THEN e.company ELSE f.company END AS company,
           CASE WHEN f.seq IS NULL THEN e.title ELSE f.title END AS title,
           CASE WHEN f.seq IS NULL THEN e.location ELSE f.location END AS location,
           CASE WHEN f.seq IS NULL THEN e.is_remote ELSE f.is_remote END AS is_remote,
           CASE WHEN f.seq IS NULL THEN e.description ELSE f.description END AS description,
           CASE WHEN f.seq IS NULL THEN e.apply_url ELSE '' END AS apply_url,
           CASE WHEN f.seq IS NULL THEN e.posted_at ELSE f.posted_at END AS posted_at,
           CASE WHEN f.seq IS NULL THEN e.dedup_hash ELSE f.dedup_hash END AS dedup_hash,
           coalesce(e.first_seen_at, {_AS_OF}) AS first_seen_at,
           CASE WHEN f.seq IS NULL THEN e.last_seen_at ELSE {_AS_OF} END AS last_seen_at,
           CASE WHEN f.seq IS NOT NULL THEN true WHEN b.source IS NOT NULL THEN false ELSE e.is_active END AS is_active,
           CASE WHEN f.seq IS NOT NULL THEN f.decision WHEN e.is_active AND b.source IS NOT NULL THEN 'deactivate'
                ELSE 'keep' END AS action
    FROM existing e FULL JOIN decided f ON e.source = f.source AND e.source_job_id = f.source_job_id
    LEFT JOIN {boards} b ON b.source = e.source AND b.board_token = e.board_token"""


CTES["reconciled"] = _reconciled()


def _with(body: str) -> str:
    """Put the named subqueries that ``body`` needs in front of it."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _text(*columns: str) -> str:
    return "REPLACE (" + ", ".join(f"cast({c} AS varchar) AS {c}" for c in columns) + ")"


_JOB_TIMES = _text("posted_at", "first_seen_at", "last_seen_at")

# --- words of the document texts -----------------------------------------------------------

# RE2 has no look-around: every character outside of tokens is doubled, so that neighbours
# do not compete for it, and a match takes one on each side.
_DOUBLED = r"regexp_replace({text}, '([^A-Za-z0-9+#])', '\1\1', 'g')"


def _word_pattern(guards: list) -> str:
    terms = sorted((t for _, _, _, ts in WORDS for t in ts), key=len, reverse=True)
    spaced = [t.replace(" ", "  ") for t in terms]
    rejected = []
    for term, before, after in guards:
        if after:
            rejected.append(term + re.escape(after))
        if before:
            rejected.append(before.replace(r"\b", "").replace(" ", "  ") + term)
    first = "".join(f"{r}|" for r in rejected)
    return f"(?i)(?:^|[^A-Za-z0-9+#])(?:{first}({'|'.join(spaced)}))(?:$|[^A-Za-z0-9+#])"


_WORDS = "(" + _values([(t, i, n, c) for i, n, c, ts in WORDS for t in ts]) + ") AS w(term, id, skill, category)"


def _found(rows: str, text: str, guards: list = ()) -> str:
    """(key columns of ``rows``, skill id) pairs found in ``text``."""
    found = f"regexp_extract_all({_DOUBLED.format(text='body')}, '{_word_pattern(list(guards))}', 1)"
    return f"""
    SELECT DISTINCT h.* EXCLUDE (form), w.id, w.skill, w.category
    FROM (SELECT * EXCLUDE (body), unnest({found}) AS form FROM (SELECT * RENAME ({text} AS body) FROM ({rows}))) h
    JOIN {_WORDS} ON w.term = replace(lower(h.form), '  ', ' ')"""


def _matched(guards: list) -> str:
    keys = "SELECT cast(doc_id AS varchar) AS job_id, text AS t FROM documents"
    return f"""
    SELECT d.job_id, coalesce(string_agg(cast(f.id AS varchar), ', ' ORDER BY f.id), '') AS ids
    FROM (SELECT cast(doc_id AS varchar) AS job_id FROM documents) d
    LEFT JOIN ({_found(keys, 't', guards)}) f USING (job_id) GROUP BY d.job_id"""


_LINKS = _found(
    "SELECT cast(doc_id AS varchar) AS job_id, substr(text, 1, 60) || chr(10) || text AS t FROM documents", "t"
)


# --- payloads -----------------------------------------------------------------------------

_READABLE = "true"  # bad payloads stand beside the good ones and hold nothing
_SEQ = "doc_id * 268435456"
_WRAPPED = _squeeze("text || ' ' || '€é'")


def _iso_at(suffix_seconds: str) -> str:
    return (
        "(TIMESTAMP '2024-02-01 00:30:00' + to_days(cast(doc_id % 28 AS int)) "
        f"+ to_hours(cast(doc_id % 24 AS int)) + to_microseconds({suffix_seconds}))"
    )


_POSTING = """
    SELECT {seq} AS seq, '{source}' AS source, {token} AS board_token, {id} AS source_job_id, {company} AS company,
           {title} AS title, {location} AS location, {remote} AS is_remote, md5({description}) AS description,
           {url} AS apply_url, cast({posted} AS varchar) AS posted_at, {raw} AS raw_title
    FROM documents WHERE {where}"""

_NORM_GREENHOUSE = _POSTING.format(
    seq=_SEQ, source="greenhouse", token="source", id="cast(doc_id AS varchar)",
    company="CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END", title="text", raw="md5(text)",
    location="CASE WHEN lang = 'en' THEN 'REMOTE, ' || source ELSE source END", remote="lang = 'en'",
    description=_WRAPPED, url="'https://b.example/' || doc_id",
    posted=f"CASE WHEN doc_id % 2 = 0 THEN {_iso_at('0')} ELSE {_iso_at('-7200000000')} END", where=_READABLE,
) + " UNION ALL " + _POSTING.format(
    seq=_SEQ + " + 6", source="greenhouse", token="source", id="'x' || doc_id", company="source", title="''", raw="NULL",
    location="NULL", remote="false", description="''", url="''", posted="NULL", where=_READABLE,
)

_NORM_LEVER = _POSTING.format(
    seq=_SEQ, source="lever", token="source", id="'l' || doc_id", company="source", title="text", raw="md5(text)",
    location="source", remote="doc_id % 2 = 0 OR doc_id % 5 = 0",
    description=f"CASE WHEN doc_id % 3 = 0 THEN {_WRAPPED} ELSE text END",
    url="CASE WHEN doc_id % 4 = 0 THEN 'https://a.example' ELSE 'https://h.example' END",
    posted="make_timestamp((1704067200000 + doc_id * 1001) * 1000)", where=_READABLE,
) + " UNION ALL " + _POSTING.format(
    seq=_SEQ + " + 1", source="lever", token="source", id="'12.5'", company="source", title="''", raw="NULL",
    location="NULL", remote="false", description="''", url="''", posted="NULL", where=_READABLE,
)

_NORM_ASHBY = _POSTING.format(
    seq=_SEQ, source="ashby", token="source", id="'a' || doc_id", company="source", title="text", raw="md5(text)",
    location="source", remote="doc_id % 2 = 0",
    description=f"CASE WHEN doc_id % 3 = 0 THEN {_WRAPPED} ELSE text END",
    url="CASE WHEN doc_id % 4 = 0 THEN 'https://j.example' ELSE 'https://a.example' END",
    posted=_iso_at("250000"), where=_READABLE,
) + " UNION ALL " + _POSTING.format(
    seq=_SEQ + " + 1", source="ashby", token="source", id="'3'", company="source", title="''", raw="NULL",
    location="NULL", remote="false", description="''", url="''", posted="NULL", where=_READABLE,
)


def _pages(max_pages: int) -> str:
    """Pages of the feeds: a page ends its feed if it names no next page."""
    return f"""
    SELECT p.* FROM documents p LEFT JOIN (
        SELECT doc_id // 5 AS feed, min(doc_id % 5 + 1) AS stop FROM documents
        WHERE doc_id % 7 = 0 GROUP BY 1
    ) e ON e.feed = p.doc_id // 5
    WHERE p.doc_id % 5 + 1 <= least({max_pages}, coalesce(e.stop, {max_pages}))"""


_NORM_ARBEITNOW = _POSTING.format(
    seq=_SEQ, source="arbeitnow", token="'arbeitnow'", id="'s' || doc_id",
    company="CASE WHEN doc_id % 3 = 0 THEN 'arbeitnow' ELSE lang END", title="text", raw="md5(text)", location="source",
    remote="doc_id % 2 = 0", description=_WRAPPED, url="'https://f.example/' || doc_id",
    posted=_at("doc_id"), where=_READABLE,
).replace("FROM documents", f"FROM ({_pages(5)})")

_PLAIN_HTML = "html"
for _entity, _char in (
    ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&"),
):
    _PLAIN_HTML = f"replace({_PLAIN_HTML}, '{_entity}', '{_char}')"

_KEY_NULL = "_dbt_utils_surrogate_key_null_"

# --- the full run -------------------------------------------------------------------------


def _full_run() -> str:
    docs = f"""
    SELECT doc_id AS seq, source AS origin, {_source('doc_id')} AS source, cast(doc_id AS varchar) AS id,
           CASE WHEN doc_id % 4 = 3 THEN 'arbeitnow' ELSE lang END AS board, text AS title,
           {_hash('lang', 'text', "''")} AS hash,
           sha256({_source('doc_id')} || '|' || doc_id) AS job_id, text || chr(10) || text AS blob
    FROM documents"""
    first = """
    SELECT * FROM (SELECT *, first_value(source) OVER (PARTITION BY hash ORDER BY seq) AS own
                   FROM docs WHERE origin NOT IN ('src1', 'src2', 'src3')) WHERE own = source"""
    second = """
    SELECT * FROM (
        SELECT d.*, k.job_id IS NOT NULL AS known, coalesce(
            last_value(CASE WHEN k.job_id IS NOT NULL THEN d.source END IGNORE NULLS) OVER (
                PARTITION BY d.hash ORDER BY d.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            o.osrc, first_value(d.source) OVER (PARTITION BY d.hash ORDER BY d.seq)) AS own
        FROM docs d LEFT JOIN first_run k ON k.job_id = d.job_id
        LEFT JOIN (SELECT hash, arg_min(source, job_id) AS osrc FROM first_run GROUP BY hash) o ON o.hash = d.hash
        WHERE d.origin <> 'src5') WHERE known OR own = source"""
    gone = """
    SELECT * FROM first_run WHERE origin = 'src5' AND NOT (source = 'lever' AND board = 'fr')"""
    # Third run, same day as the second: two more origins list nothing.
    second_active = """
    SELECT job_id, seq, origin, source, id, board, title, hash, blob FROM second_run
    UNION ALL
    SELECT job_id, seq, origin, source, id, board, title, hash, blob FROM first_run
    WHERE origin = 'src5' AND source = 'lever' AND board = 'fr'"""
    third = """
    SELECT * FROM (
        SELECT d.*, k.job_id IS NOT NULL OR g.job_id IS NOT NULL AS known, coalesce(
            last_value(CASE WHEN k.job_id IS NOT NULL OR g.job_id IS NOT NULL THEN d.source END IGNORE NULLS) OVER (
                PARTITION BY d.hash ORDER BY d.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            o.osrc, first_value(d.source) OVER (PARTITION BY d.hash ORDER BY d.seq)) AS own
        FROM docs d LEFT JOIN second_active k ON k.job_id = d.job_id LEFT JOIN gone g ON g.job_id = d.job_id
        LEFT JOIN (SELECT hash, arg_min(source, job_id) AS osrc FROM second_active GROUP BY hash) o ON o.hash = d.hash
        WHERE d.origin NOT IN ('src5', 'src9', 'src14')) WHERE known OR own = source"""
    third_gone = """
    SELECT * FROM second_active WHERE origin IN ('src5', 'src9', 'src14')"""
    third_active = """
    SELECT job_id, title, hash, blob FROM third_run"""
    roles = _values(DOCUMENT_ROLES)

    def demand(active: str) -> str:
        kept = f"""
        SELECT * FROM (SELECT job_id, lower(title) AS title, blob, row_number() OVER (PARTITION BY hash ORDER BY job_id) AS rn
                       FROM {active}) WHERE rn = 1"""
        links = _found(f"SELECT job_id, title, blob AS t FROM ({kept})", "t")
        return f"""
        SELECT r.role, f.skill, count(DISTINCT f.job_id) AS n FROM ({links}) f
        JOIN (SELECT * FROM ({roles}) AS t(role, pattern)) r ON contains(f.title, r.pattern) GROUP BY ALL"""

    boards = "(SELECT count(*) FROM (SELECT DISTINCT source, board FROM docs))"
    raw = "(SELECT count(*) FROM docs WHERE {})"

    def row(run: str, status: str, failed: int, fetched: str, upserted: str, gone_rows: str, errors: str) -> str:
        return f"""
        SELECT '{run}' AS run_id, {status} AS status, cast({boards} AS bigint) AS boards_attempted,
               cast({boards} - {failed} AS bigint) AS boards_succeeded, cast({raw.format(fetched)} AS bigint) AS raw_fetched,
               cast((SELECT count(*) FROM {upserted}) AS bigint) AS jobs_upserted,
               cast({gone_rows} AS bigint) AS jobs_deactivated, {errors} AS errors"""

    ever_links = _found("SELECT job_id, blob AS t FROM ever", "t")
    return f"""
    WITH docs AS ({docs}), first_run AS ({first}), second_run AS ({second}), gone AS ({gone}),
    second_active AS ({second_active}), third_run AS ({third}), third_gone AS ({third_gone}),
    third_active AS ({third_active}), day1 AS ({demand('first_run')}), day2 AS ({demand('third_active')}),
    ever AS (
        SELECT * FROM docs WHERE job_id IN (SELECT job_id FROM first_run UNION SELECT job_id FROM second_run UNION SELECT job_id FROM third_run)),
    days AS (SELECT 1 AS day, * FROM day1 UNION ALL SELECT 2, * FROM day2),
    runs AS (
        {row('d1', "'succeeded'", 0, "origin NOT IN ('src1', 'src2', 'src3')", 'first_run', '0', 'NULL')}
        UNION ALL
        {row('d2', "'completed_with_errors'", 1, "origin <> 'src5'", 'second_run', '(SELECT count(*) FROM gone)', "'lever/fr: 503'")}
        UNION ALL
        {row('d3', "'succeeded'", 0, "origin NOT IN ('src5', 'src9', 'src14')", 'third_run', '(SELECT count(*) FROM third_gone)', 'NULL')})
    SELECT 'run' AS kind, run_id AS key, concat_ws('|', status, boards_attempted, boards_succeeded, raw_fetched, jobs_upserted, jobs_deactivated, errors) AS value
    FROM runs
    UNION ALL SELECT 'error', 'd2|lever|fr', 'lever/fr: 503'
    UNION ALL SELECT 'job', job_id, concat_ws('|', source, id, board, job_id IN (SELECT job_id FROM third_run),
        CASE WHEN job_id IN (SELECT job_id FROM first_run) THEN 1 ELSE 2 END,
        CASE WHEN job_id IN (SELECT job_id FROM second_run UNION ALL SELECT job_id FROM third_run) THEN 2 ELSE 1 END) FROM ever
    UNION ALL SELECT 'link', concat_ws('|', job_id, skill), category FROM ({ever_links})
    UNION ALL SELECT 'demand', concat_ws('|', role, skill, day), cast(n AS varchar) FROM days
    UNION ALL SELECT 'trend', concat_ws('|', role, skill, day), cast(n AS varchar) FROM days"""


_ORACLE: dict[str, str] = {
    "src_boards": """
        SELECT * FROM (
            SELECT (['greenhouse', 'lever', 'ashby', 'workday'])[cast(s_suppkey % 4 + 1 AS int)] AS source,
                   CASE WHEN s_suppkey % 7 <> 0 THEN 'b' || s_suppkey ELSE '' END AS board_token, s_name AS company
            FROM supplier) WHERE source <> 'workday' AND board_token <> ''
        UNION ALL SELECT 'arbeitnow', s_name, s_name FROM supplier""",
    "src_dictionary": """
        SELECT p_partkey, 1 AS skill_id, p_name AS name, p_type AS category, p_brand AS aliases FROM part
        UNION ALL SELECT p_partkey, 2, p_brand, '', '' FROM part""",
    "src_roles": "SELECT p_type AS role, p_name AS pattern FROM part",
    "norm_greenhouse": _NORM_GREENHOUSE,
    "norm_lever": _NORM_LEVER,
    "norm_ashby": _NORM_ASHBY,
    "norm_arbeitnow": _NORM_ARBEITNOW,
    "norm_paged_feed": f"""
        SELECT doc_id AS seq, 'arbeitnow' AS source, cast(doc_id // 5 AS varchar) AS board_token,
               cast(doc_id % 5 + 1 AS int) AS page_no FROM ({_pages(2)})
        UNION ALL
        SELECT doc_id + 50000000, 'arbeitnow', cast((doc_id + 50000000) // 5 AS varchar), cast(doc_id % 5 + 1 AS int)
        FROM documents WHERE (doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0) AND doc_id % 5 + 1 <= 2
        AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id // 5 = documents.doc_id // 5 AND e.doc_id < documents.doc_id
                        AND (e.doc_id % 17 = 0 OR e.doc_id % 19 = 0 OR e.doc_id % 23 = 0))""",
    "norm_repeated_keys": f"""
        SELECT {_SEQ} AS seq, cast(doc_id AS varchar) AS source_job_id, lang AS title, source AS location FROM documents
        UNION ALL SELECT {_SEQ} + 1, 'x' || doc_id, '', NULL FROM documents""",
    "run_unreadable_payload": """
        WITH n AS (SELECT count(*) AS docs, count(*) FILTER (lang <> 'fr') AS others, count(DISTINCT lang) AS langs FROM documents)
        SELECT 'r1' AS run_id, 'succeeded' AS status, langs AS boards_attempted, langs AS boards_succeeded, docs AS raw_fetched,
               docs AS jobs_upserted, cast(0 AS bigint) AS jobs_deactivated, NULL AS errors, docs AS active FROM n
        UNION ALL
        SELECT 'r2', 'completed_with_errors', langs, langs - 1, others, others, 0, 'lever/fr: unreadable payload', docs FROM n""",
    "schema_defaults": """
        SELECT job_id, false AS is_remote, CASE WHEN source = 'lever' THEN description ELSE '' END AS description,
               '' AS apply_url, true AS is_active FROM jobs""",
    "resolve_tool": f"""
        SELECT c_custkey, query, coalesce(matches, '') AS matches FROM asked_queries LEFT JOIN asked_lists USING (query)""",
    "posting_roles_table": """
        SELECT DISTINCT cast(c_custkey AS varchar) AS job_id, p_brand AS role
        FROM customer JOIN part ON contains(lower(c_name), cast(p_partkey AS varchar))""",
    "bronze_roundtrip": f"""
        SELECT 'first' AS run_id, {_SEQ} AS seq, 'lever' AS source, source AS board_token, 'l' || doc_id AS source_job_id,
               '2025-03-01 12:00:00' AS fetched_at, cast(1704067200000 + doc_id * 1001 AS varchar) AS created
        FROM documents WHERE {_READABLE}
        UNION ALL
        SELECT 'first', {_SEQ} + 1, 'lever', source, '12.5', '2025-03-01 12:00:00', '2024' FROM documents WHERE {_READABLE}""",
    "silver_rewrite": f"""
        SELECT * REPLACE (NOT is_active AS is_active, cast(posted_at AS varchar) AS posted_at,
                          cast(first_seen_at AS varchar) AS first_seen_at, cast(last_seen_at AS varchar) AS last_seen_at)
        FROM jobs WHERE source <> 'lever'""",
    "links_replace_all": "SELECT * FROM job_skills WHERE skill <> 'NATION_1'",
    "links_replace_for": """
        SELECT * FROM job_skills WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE location = 'ECONOMY')
        UNION ALL SELECT job_id, 'fresh', NULL FROM jobs WHERE location = 'ECONOMY' AND is_active""",
    "demand_replace_snapshot": """
        SELECT role, skill, category, job_count, cast(d AS varchar) AS snapshot_date FROM (
            SELECT *, snapshot_date AS d FROM demand WHERE snapshot_date NOT IN (DATE '2024-01-06', DATE '2024-01-07')
            UNION ALL
            SELECT *, DATE '2024-01-06' FROM demand WHERE snapshot_date = DATE '2024-01-05' AND job_count > 1)
        UNION ALL
        SELECT role, skill, 'trends', job_count, cast(d AS varchar) FROM (
            SELECT *, snapshot_date AS d FROM demand WHERE snapshot_date NOT IN (DATE '2024-01-06', DATE '2024-01-07')
            UNION ALL
            SELECT *, DATE '2024-01-06' FROM demand WHERE snapshot_date = DATE '2024-01-05' AND job_count > 1)""",
    "serving_export": """
        SELECT 'jobs' AS table_name, job_id AS key, concat_ws('|', source, source_job_id, title, dedup_hash, 0, is_active) AS value FROM jobs
        UNION ALL SELECT 'job_skills', concat_ws('|', job_id, skill), category FROM job_skills
        UNION ALL SELECT 'skill_demand', concat_ws('|', role, skill, coalesce(category, '-'), snapshot_date), cast(job_count AS varchar) FROM demand
        UNION ALL SELECT 'skill_trends', concat_ws('|', role, skill, snapshot_date), cast(job_count AS varchar) FROM demand
        UNION ALL SELECT 'ingestion_runs', cast(run_id AS varchar), concat_ws('|', started_at, finished_at) FROM runs""",
    "run_summary": """
        SELECT run_id, cast(count(*) AS bigint) AS boards_attempted, cast(count(*) FILTER (n < 20) AS bigint) AS boards_succeeded,
               CASE WHEN count(*) FILTER (n >= 20) = 0 THEN 'succeeded' WHEN count(*) FILTER (n < 20) > 0
                    THEN 'completed_with_errors' ELSE 'failed' END AS status,
               string_agg(board || ': ' || n, chr(10) ORDER BY board || ': ' || n) FILTER (n >= 20) AS errors
        FROM (SELECT cast(cast(ts AS date) AS varchar) AS run_id, 'b' || (user_id % 36) AS board,
                     count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY ALL) GROUP BY run_id""",
    "run_audit": f"""
        SELECT 'r' AS run_id, 'manual' AS trigger, '2025-03-01 12:00:00' AS started_at, '2025-03-01 12:00:00' AS finished_at,
               CASE WHEN (SELECT count(*) FROM boards WHERE source = 'ashby') = 0 THEN 'succeeded'
                    WHEN (SELECT count(*) FROM boards WHERE source <> 'ashby') > 0 THEN 'completed_with_errors'
                    ELSE 'failed' END AS status,
               (SELECT cast(count(*) AS bigint) FROM boards) AS boards_attempted,
               (SELECT cast(count(*) AS bigint) FROM boards WHERE source <> 'ashby') AS boards_succeeded,
               (SELECT cast(count(*) AS bigint) FROM fetched) AS raw_fetched,
               (SELECT cast(count(*) AS bigint) FROM decided WHERE decision <> 'skip') AS jobs_upserted,
               (SELECT cast(count(*) AS bigint) FROM ({_reconciled("(SELECT * FROM boards WHERE source <> 'ashby')")})
                WHERE action = 'deactivate') AS jobs_deactivated,
               (SELECT string_agg('ashby/' || board_token || ': timeout', chr(10) ORDER BY board_token)
                FROM boards WHERE source = 'ashby') AS errors,
               (SELECT count(*) FROM fetched WHERE regexp_matches(title, '\\S') AND NOT regexp_matches(lower(title), '[a-z0-9]')) AS blank_titles,
               (SELECT count(DISTINCT lower(company) || coalesce(lower(location), '')) FROM fetched
                WHERE regexp_matches(title, '\\S') AND NOT regexp_matches(lower(title), '[a-z0-9]')) AS blank_title_hashes""",
    "run_error_lines": """
        SELECT run_id, 'greenhouse' AS source, board AS board_token, board || ': ' || n AS error
        FROM (SELECT cast(cast(ts AS date) AS varchar) AS run_id, 'b' || (user_id % 36) AS board,
                     count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY ALL) WHERE n >= 2""",
    "run_blank_keys": """
        SELECT count(*) AS blank_titles, count(DISTINCT company) AS blank_title_hashes FROM fetched
        WHERE regexp_matches(title, '\\S') AND (seq % 3 = 0 OR NOT regexp_matches(lower(title), '[a-z0-9]'))""",
    "links_default_guards": f"""
        WITH t AS (SELECT 'd' || doc_id AS job_id, doc_id % 12 AS k, text FROM documents
                   UNION ALL SELECT 'c' || (conv_id * 1000 + turn), (conv_id * 1000 + turn) % 12, text FROM conversations),
        r AS (SELECT job_id, k, len(list_filter(regexp_extract_all({_DOUBLED.format(text='text')},
                  '(?i)(?:^|[^A-Za-z0-9+#])(?:r[&$]|(r))(?:$|[^A-Za-z0-9+#])', 1), lambda x: x <> '')) > 0 AS said,
                  k = 10 OR regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9+#])(?:and|und|et)(?:$|[^A-Za-z0-9+#])') AS joint FROM t)
        SELECT job_id, 'Go' AS skill, 'Language' AS category FROM t WHERE k IN (0, 11)
        UNION ALL SELECT job_id, 'C', 'Language' FROM t WHERE k = 10
        UNION ALL SELECT job_id, 'R', 'Language' FROM r WHERE k = 10 OR said
        UNION ALL SELECT job_id, 'Joint', 'Word' FROM r WHERE joint""",
    "strip_html_pages": f"""
        SELECT page_id, {_squeeze(f"regexp_replace({_PLAIN_HTML}, '<[^>]+>', ' ', 'g')")} AS plain_text FROM pages""",
    "normalize_key": f"SELECT doc_id, md5({_norm('text')}) AS key_md5 FROM documents",
    "dedup_hash": f"""
        SELECT doc_id, {_hash('lang', 'text', "CASE WHEN doc_id % 3 <> 0 THEN source END")} AS dedup_hash FROM documents""",
    "job_id": "SELECT doc_id, sha256(source || '|' || doc_id) AS job_id FROM documents",
    "surrogate_keys": f"""
        SELECT p_partkey, md5(b) AS one, md5(p_partkey || '-' || b) AS two
        FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand ELSE '{_KEY_NULL}' END AS b FROM part)""",
    "looks_remote": "SELECT p_partkey, p_size % 3 = 0 AS remote FROM part",
    "parse_iso": """
        SELECT event_id, cast(CASE event_id % 10
            WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts
            WHEN 2 THEN date_trunc('second', ts) - INTERVAL '5 hours 30 minutes'
            WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('second', ts)
            WHEN 8 THEN date_trunc('minute', ts) + INTERVAL '3 hours' END AS varchar) AS parsed FROM events""",
    "epoch_time": """
        SELECT event_id,
               cast(date_trunc('second', ts) + to_milliseconds(event_id % 1000) AS varchar) AS from_ms,
               cast(date_trunc('second', ts) AS varchar) AS from_s FROM events""",
    "json_typed_access": """
        SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS a, event_id % 3 = 0 AS b,
               CASE WHEN event_id % 5 <> 0 THEN cast(json_extract_string(props, '$.k') AS bigint) END AS k FROM events""",
    "json_get_id": """
        SELECT event_id, CASE event_id % 7 WHEN 0 THEN cast(event_id AS varchar) WHEN 1 THEN 'e-' || event_id
               WHEN 2 THEN cast(event_id AS varchar) WHEN 3 THEN event_id || '.5'
               WHEN 5 THEN cast(event_id * 100 AS varchar) END AS id FROM events""",
    "dictionary_terms": """
        SELECT term, skill_id, ' ' || p_name AS skill, category FROM (
            SELECT *, row_number() OVER (PARTITION BY term ORDER BY skill_id, place) AS rn FROM (
                SELECT lower(trim(p_name)) AS term, p_partkey AS skill_id, 0 AS place, p_name, p_type AS category FROM part
                UNION ALL SELECT lower(p_brand), p_partkey, 1, p_name, p_type FROM part
                UNION ALL SELECT lower(p_type), p_partkey, 3, p_name, p_type FROM part)) WHERE rn = 1""",
    "skill_match": _matched([]),
    "skill_match_guarded": _matched(WORD_GUARDS),
    "extract_links": f"SELECT job_id, skill, category FROM ({_LINKS})",
    "texts_for_ids": """
        SELECT cast(doc_id AS varchar) AS job_id, md5(substr(text, 1, 60)) AS title, md5(text) AS description
        FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
    "extract_incremental": f"""
        SELECT job_id, skill, category FROM ({_LINKS}) 
        WHERE job_id IN (SELECT cast(doc_id AS varchar) FROM labels WHERE quality = 1)
        UNION ALL SELECT cast(doc_id AS varchar), 'old', NULL FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "user_skill_parse": f"""
        SELECT c.user_id, coalesce(string_agg(f.skill, ', ' ORDER BY f.skill), '') AS skills
        FROM (SELECT conv_id * 1000 + turn AS user_id FROM conversations WHERE role = 'user') c
        LEFT JOIN ({_found("SELECT conv_id * 1000 + turn AS user_id, text AS t FROM conversations WHERE role = 'user'", 't')}) f
        USING (user_id) GROUP BY c.user_id""",
    "resolve_skill_dictionary": f"""
        SELECT c.conv_id, c.turn, coalesce(string_agg(f.skill, ', ' ORDER BY f.skill) FILTER (f.place <= 3), '') AS matches
        FROM conversations c LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY skill) AS place FROM (
                {_found("SELECT conv_id, turn, text AS t FROM conversations", 't')})) f
        USING (conv_id, turn) GROUP BY c.conv_id, c.turn""",
    "run_dedup": "SELECT source, source_job_id, seq, title FROM arrivals",
    "reconcile_decisions": "SELECT source, source_job_id, seq, decision FROM decided",
    "reconcile": f"SELECT * EXCLUDE (action) {_JOB_TIMES} FROM reconciled WHERE action <> 'skip'",
    "reconcile_deactivate": """
        SELECT job_id, is_active, cast(last_seen_at AS varchar) AS last_seen_at FROM reconciled WHERE action = 'deactivate'""",
    "reconcile_counts": "SELECT action, count(*) AS jobs FROM reconciled GROUP BY action",
    "stg_jobs": f"""
        SELECT * EXCLUDE (description) {_JOB_TIMES}, lower(title) AS title_lower FROM jobs""",
    "stg_job_skills": "SELECT * FROM stg_skills",
    "fact_job_posting": """
        SELECT job_id, dedup_hash, md5(company) AS company_key,
               cast(cast(coalesce(posted_at, first_seen_at) AS date) AS varchar) AS posted_date_key,
               cast(cast(first_seen_at AS date) AS varchar) AS first_seen_date_key, source, board_token, company, title,
               title_lower, location, is_remote, apply_url, cast(posted_at AS varchar) AS posted_at,
               cast(first_seen_at AS varchar) AS first_seen_at, cast(last_seen_at AS varchar) AS last_seen_at,
               1 AS posting_count FROM fact""",
    "fact_job_skill": """
        SELECT md5(job_id || '-' || skill) AS job_skill_key, job_id, dedup_hash, md5(skill) AS skill_key, skill,
               s.category, md5(company) AS company_key,
               cast(cast(coalesce(posted_at, first_seen_at) AS date) AS varchar) AS posted_date_key
        FROM fact JOIN stg_skills s USING (job_id)""",
    "posting_roles": "SELECT job_id, role FROM posting_roles",
    "dim_company": """
        SELECT md5(company) AS company_key, company, cast(min(first_seen_at) AS varchar) AS first_seen_at,
               cast(max(last_seen_at) AS varchar) AS last_seen_at, count(DISTINCT dedup_hash) AS active_postings,
               count(DISTINCT source) AS source_count FROM jobs WHERE is_active GROUP BY company""",
    "dim_skill": """
        SELECT md5(skill) AS skill_key, skill, min(category) AS category, count(DISTINCT job_id) AS active_postings,
               cast(min(first_seen_at) AS varchar) AS first_seen_at, cast(max(last_seen_at) AS varchar) AS last_seen_at
        FROM stg_skills JOIN jobs USING (job_id) WHERE is_active GROUP BY skill""",
    "dim_role": "SELECT md5(role) AS role_key, role FROM (SELECT DISTINCT title AS role FROM jobs)",
    "dim_date": """
        SELECT cast(d AS varchar) AS date_key, cast(year(d) AS int) AS year, cast(month(d) AS int) AS month,
               cast(day(d) AS int) AS day, cast(isodow(d) AS int) AS iso_day_of_week, strftime(d, '%Y-%m') AS year_month,
               isodow(d) >= 6 AS is_weekend
        FROM (SELECT cast(unnest(generate_series(
                  cast(least(min(first_seen_at), min(posted_at)) AS date)::timestamp,
                  cast(greatest(max(last_seen_at), max(posted_at), TIMESTAMP '2025-03-01 12:00:00') AS date)::timestamp
                      + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS date) AS d FROM jobs)""",
    "skill_demand": "SELECT *, '2025-03-01' AS snapshot_date FROM part_demand",
    "skill_trends": "SELECT role, skill, cast(snapshot_date AS varchar) AS snapshot_date, job_count FROM demand",
    "scan_active_jobs": "SELECT job_id, title, dedup_hash FROM jobs WHERE is_active",
    "market_overview": """
        SELECT (SELECT count(*) FROM jobs WHERE is_active) AS active_jobs,
               (SELECT count(DISTINCT skill) FROM job_skills) AS skills_observed,
               (SELECT strftime(max(finished_at), '%Y-%m-%d %H:%M') FROM runs) AS last_refresh""",
    "list_roles": """
        SELECT DISTINCT role FROM demand WHERE snapshot_date = (SELECT max(snapshot_date) FROM demand)""",
    "distinct_lists": """
        SELECT DISTINCT 'skill' AS kind, skill AS value FROM job_skills
        UNION ALL SELECT DISTINCT 'source', source FROM jobs""",
    "role_total": """
        SELECT count(DISTINCT dedup_hash) AS role_total FROM jobs
        WHERE is_active AND (lower(title) LIKE '%bolt%' OR lower(title) LIKE '%rod%')""",
    "role_totals": "SELECT role, role_total FROM role_totals",
    "demand_latest": """
        SELECT skill, category, job_count FROM demand
        WHERE role = 'click' AND snapshot_date = (SELECT max(snapshot_date) FROM demand)
        ORDER BY job_count DESC, skill, category NULLS LAST LIMIT 10""",
    "top_skills_share": """
        SELECT role, t.role_total, skill, category, job_count,
               CASE WHEN t.role_total > 0 THEN cast(printf('%.1f', 100.0::double * job_count / t.role_total) AS double)
                    ELSE 0.0 END AS share_pct
        FROM part_demand JOIN role_totals t USING (role) WHERE role = 'Fastener'
        ORDER BY job_count DESC, skill, category NULLS LAST LIMIT 15""",
    "trends_topn": """
        SELECT cast(snapshot_date AS varchar) AS snapshot_date, skill, job_count FROM demand
        WHERE role = 'view' AND skill IN (
            SELECT skill FROM demand WHERE role = 'view'
              AND snapshot_date = (SELECT max(snapshot_date) FROM demand WHERE role = 'view')
            ORDER BY job_count DESC, skill LIMIT 5)""",
    "trend_days": """
        SELECT count(DISTINCT snapshot_date) AS snapshots FROM demand
        WHERE role = 'view' AND skill IN (
            SELECT skill FROM demand WHERE role = 'view'
              AND snapshot_date = (SELECT max(snapshot_date) FROM demand WHERE role = 'view')
            ORDER BY job_count DESC, skill LIMIT 5)""",
    "companies_hiring": """
        SELECT company, count(*) AS job_count FROM jobs
        WHERE is_active AND job_id IN (SELECT job_id FROM job_skills WHERE skill = 'NATION_3')
        GROUP BY company ORDER BY job_count DESC, company LIMIT 10""",
    "jobs_with_skill": """
        SELECT job_id, title, is_active FROM jobs
        WHERE job_id IN (SELECT job_id FROM job_skills WHERE skill = 'NATION_7')""",
    "filter_substring": """
        SELECT job_id, company, location, title FROM jobs
        WHERE is_active AND lower(company) LIKE '%brand#1%' AND lower(location) LIKE '%o%' AND lower(title) LIKE '%red%'""",
    "filter_remote": """
        SELECT job_id, source, is_remote FROM jobs
        WHERE is_active AND ((source = 'lever' AND is_remote) OR (source = 'ashby' AND NOT is_remote))""",
    "job_count": """
        SELECT count(*) AS n FROM jobs WHERE is_active AND lower(title) LIKE '%ring%'
          AND job_id IN (SELECT job_id FROM job_skills WHERE skill = 'NATION_3')""",
    "find_jobs": """
        SELECT (SELECT count(*) FROM jobs WHERE is_active AND lower(title) LIKE '%ring%'
                AND job_id IN (SELECT job_id FROM job_skills WHERE skill = 'NATION_3')) AS total_matches,
               company, title, location, is_remote AS remote, apply_url
        FROM (SELECT DISTINCT company, title, location, is_remote, source, apply_url, posted_at FROM jobs
              WHERE is_active AND lower(title) LIKE '%ring%'
                AND job_id IN (SELECT job_id FROM job_skills WHERE skill = 'NATION_3')
              ORDER BY posted_at DESC NULLS LAST, company, title, location, is_remote, source, apply_url LIMIT 40)""",
    "jobs_page": """
        SELECT company, title, location, is_remote, source, apply_url, cast(posted_at AS varchar) AS posted_at, skills
        FROM (SELECT company, title, location, is_remote, source, apply_url, posted_at,
                     string_agg(skill, ', ' ORDER BY skill) AS skills
              FROM jobs LEFT JOIN job_skills USING (job_id) WHERE is_active AND lower(title) LIKE '%ring%'
              GROUP BY company, title, location, is_remote, source, apply_url, posted_at
              ORDER BY posted_at DESC NULLS LAST, company, title, location, is_remote, source, apply_url
              LIMIT 25 OFFSET 25)""",
    "jobs_page_after": """
        SELECT company, title, location, is_remote, source, apply_url, cast(posted_at AS varchar) AS posted_at, skills
        FROM (SELECT company, title, location, is_remote, source, apply_url, posted_at,
                     string_agg(skill, ', ' ORDER BY skill) AS skills
              FROM jobs LEFT JOIN job_skills USING (job_id) WHERE is_active AND lower(title) LIKE '%ring%'
              GROUP BY company, title, location, is_remote, source, apply_url, posted_at
              ORDER BY posted_at DESC NULLS LAST, company, title, location, is_remote, source, apply_url
              LIMIT 25 OFFSET 25)""",
    "resolve_skill": """
        SELECT DISTINCT skill FROM job_skills WHERE contains(lower(skill), 'nation_1') ORDER BY skill LIMIT 15""",
    "skill_gap": "SELECT * FROM gap",
    "skill_gap_coverage": """
        SELECT user_id, role, role_total, count(*) FILTER (have) AS have, count(*) FILTER (NOT have) AS missing,
               coalesce(sum(job_count) FILTER (have), 0) / sum(job_count) AS coverage
        FROM gap GROUP BY user_id, role, role_total""",
    "gap_top8": """
        SELECT user_id, role, cast(place AS int) AS place, skill, job_count,
               cast(cast(round_even(share * 100, 0) AS int) AS varchar) || '%' AS share
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, role ORDER BY job_count DESC, skill, category NULLS LAST) AS place
              FROM gap WHERE NOT have) WHERE place <= 8""",
    "dq_not_null": """
        SELECT 'not_null' AS "check", c AS "column", n AS failures FROM (
            SELECT 'job_id' AS c, count(*) FILTER (job_id IS NULL) AS n FROM jobs
            UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM jobs
            UNION ALL SELECT 'dedup_hash', count(*) FILTER (dedup_hash IS NULL) FROM jobs
            UNION ALL SELECT 'is_active', count(*) FILTER (is_active IS NULL) FROM jobs
            UNION ALL SELECT 'posted_at', count(*) FILTER (posted_at IS NULL) FROM jobs)""",
    "dq_unique": """
        SELECT 'unique' AS "check", 'job_id' AS "column", count(*) AS failures
        FROM (SELECT job_id FROM jobs GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'unique', 'dedup_hash', count(*)
        FROM (SELECT dedup_hash FROM jobs GROUP BY 1 HAVING count(*) > 1)""",
    "dq_unique_combo": """
        SELECT 'unique_combination' AS "check", 'job_id, skill' AS "column", count(*) AS failures
        FROM (SELECT job_id, skill FROM raw_links GROUP BY 1, 2 HAVING count(*) > 1)""",
    "dq_accepted": """
        SELECT 'accepted_values' AS "check", 'category' AS "column", count(DISTINCT category) AS failures
        FROM raw_links WHERE category NOT IN ('AFRICAA', 'AFRICAN', 'ASIAR')""",
    "dq_relationships": """
        SELECT 'relationships' AS "check", 'job_id' AS "column", count(*) AS failures FROM raw_links
        WHERE job_id NOT IN (SELECT job_id FROM fact)
        UNION ALL SELECT 'relationships', 'company_key', count(*) FROM fact
        WHERE md5(company) NOT IN (SELECT md5(company) FROM jobs WHERE is_active)""",
    "dq_freshness": """
        SELECT cast(last AS varchar) AS last_loaded_at, age AS age_seconds,
               CASE WHEN age > 14 * 86400 THEN 'error' WHEN age > 3 * 86400 THEN 'warn' ELSE 'pass' END AS status
        FROM (SELECT max(last_seen_at) AS last,
                     cast(epoch(TIMESTAMP '2024-05-25') - epoch(max(last_seen_at)) AS bigint) AS age FROM jobs)""",
    "full_run": _full_run(),
}


# --- declared checks ----------------------------------------------------------------------

for _model in ("stg_jobs", "stg_job_skills", "dim_date", "dim_company", "dim_skill", "fact_job_posting", "fact_job_skill"):
    CTES[f"m_{_model}"] = _ORACLE[_model]
CTES["asked_queries"] = f"""
            SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN c_mktsegment || ' and is'
                                                 ELSE substr(n_name, 3, 5) END AS query
            FROM customer JOIN nation ON c_nationkey = n_nationkey"""
CTES["asked_known"] = f"""{_found("SELECT DISTINCT query, query AS t FROM asked_queries", "t")}"""
CTES["asked_observed"] = f"""
            SELECT query, skill FROM (SELECT DISTINCT query FROM asked_queries WHERE query NOT IN (SELECT query FROM asked_known))
            JOIN (SELECT DISTINCT skill FROM job_skills) ON contains(lower(skill), lower(query))"""
CTES["asked_placed"] = f"""
            SELECT query, skill, row_number() OVER (PARTITION BY query ORDER BY skill) AS place
            FROM (SELECT DISTINCT query, skill FROM asked_known UNION ALL SELECT query, skill FROM asked_observed)"""
CTES["asked_lists"] = f"""SELECT query, string_agg(skill, ', ' ORDER BY skill) AS matches FROM asked_placed WHERE place <= 15 GROUP BY query"""
CTES["m_seed_roles"] = "SELECT role, pattern FROM roles"
CTES["m_dim_role"] = "SELECT DISTINCT md5(role) AS role_key, role FROM roles"
CTES["m_skill_demand"] = """
    SELECT role, skill, category, count(DISTINCT job_id) AS job_count, '2025-03-01' AS snapshot_date
    FROM posting_roles JOIN stg_skills USING (job_id) GROUP BY role, skill, category"""
CTES["m_skill_trends"] = "SELECT role, skill, job_count, snapshot_date FROM m_skill_demand"


def _checks() -> str:
    def row(model: str, check: str, column: str, count: str) -> str:
        return f"SELECT '{model}' AS model, '{check}' AS \"check\", '{column}' AS \"column\", ({count}) AS failures"

    rows = []
    for model, columns in quality.NOT_NULL.items():
        rows += [row(model, "not_null", c, f"SELECT count(*) FROM m_{model} WHERE {c} IS NULL") for c in columns]
    for model, columns in quality.UNIQUE.items():
        for c in columns:
            repeated = f"SELECT {c} FROM m_{model} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
            rows.append(row(model, "unique", c, f"SELECT count(*) FROM ({repeated})"))
    for model, columns in quality.UNIQUE_COMBINATION.items():
        keys = ", ".join(columns)
        repeated = f"SELECT {keys} FROM m_{model} GROUP BY {keys} HAVING count(*) > 1"
        rows.append(row(model, "unique_combination", keys, f"SELECT count(*) FROM ({repeated})"))
    for model, (c, values) in quality.ACCEPTED.items():
        accepted = ", ".join(f"'{v}'" for v in values)
        rows.append(row(model, "accepted_values", c, f"SELECT count(DISTINCT {c}) FROM m_{model} WHERE {c} NOT IN ({accepted})"))
    for child, c, parent, field in quality.RELATIONSHIPS:
        orphans = f"SELECT count(*) FROM m_{child} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {field} FROM m_{parent})"
        rows.append(row(child, "relationships", c, orphans))
    return "\nUNION ALL ".join(rows)


_ORACLE["dq_models"] = _checks()


def oracle_sql() -> dict[str, str]:
    return {name: sql if name == "full_run" else _with(sql) for name, sql in _ORACLE.items()}

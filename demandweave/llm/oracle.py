"""The queries that SQL can state, in DuckDB's SQL."""

from __future__ import annotations

from demandweave.llm.queries import LISTED_HOSTS, URL_RULES
from demandweave.llm.quality_rules import RULES, STOP_WORDS
from demandweave.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    names = []
    for rule in RULES:
        bounds = [f"100 * {rule.part} < {rule.least} * {rule.whole}"] if rule.least is not None else []
        bounds += [f"100 * {rule.part} > {rule.most} * {rule.whole}"] if rule.most is not None else []
        names.append(f"CASE WHEN {rule.whole} > 0 AND ({' OR '.join(bounds)}) THEN '{rule.name}' END")
    alone = [f"({n}) IS NULL" for n, rule in zip(names, RULES) if rule.alone]
    return rf"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d),
    keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM windows),
    twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed),
    covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
    counted AS (
        SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
               length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
               len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words, len(l) AS n_lines,
               len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM d LEFT JOIN covered USING (doc_id)),
    judged AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               concat_ws(',', {', '.join(names)}) AS broken_rules FROM counted)
    SELECT *, NOT base_failed AND {' AND '.join(alone)} AS kept FROM judged"""


def _url_filters() -> str:
    host = _low(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")
    path = r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    query = r"string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&')"
    rule = "CASE"
    for r in sorted(URL_RULES, key=lambda r: (-len(r.name), r.name)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        rule += f" WHEN {fits} THEN '{r.name}'"
    verdict = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in URL_RULES)
    return rf"""
    WITH p AS (
        SELECT page_id, url, coalesce({host}, '') AS host, coalesce({path}, '') AS path,
               list_sort(list_filter({query}, lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS q
        FROM pages),
    c AS (
        SELECT *, CASE WHEN contains(url, '://') THEN
            regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
            || regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/index\.html?$', ''), '/$', '')
            || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical
        FROM p),
    r AS (
        SELECT *, {rule} END AS rule, coalesce(canonical IN (
            SELECT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, '{LISTED_HOSTS}')), false) AS listed
        FROM c)
    SELECT page_id, host, path, rule, listed,
           coalesce(CASE rule {verdict} END, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
    FROM r"""


_PREFERENCE = r"""
    WITH l AS (
        SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id),
    reply AS (
        SELECT conv_id, last, max(text) AS reply FROM l JOIN conversations c USING (conv_id)
        WHERE c.turn = last AND role = 'assistant' GROUP BY ALL),
    pairs AS (
        SELECT conv_id AS pair_id, last, lead(reply, 1, first) OVER (ORDER BY conv_id) AS other
        FROM (SELECT *, first_value(reply) OVER (ORDER BY conv_id) AS first, count(*) OVER () AS n FROM reply) WHERE n > 1),
    chosen AS (
        SELECT pair_id, turn, role, text, last FROM pairs JOIN conversations ON conv_id = pair_id WHERE turn <= last),
    rejected AS (
        SELECT pair_id, turn, role, text FROM chosen WHERE turn < last
        UNION ALL SELECT pair_id, last, 'assistant', other FROM pairs),
    both_sides AS (
        SELECT pair_id, turn, role, text, min(side) AS a, max(side) AS b
        FROM (SELECT pair_id, turn, role, text, 0 AS side FROM chosen UNION ALL SELECT pair_id, turn, role, text, 1 FROM rejected)
        GROUP BY ALL),
    split AS (SELECT pair_id, min(turn) AS split FROM both_sides WHERE a = b GROUP BY pair_id),
    rows_ AS (
        SELECT pair_id, CASE WHEN turn >= split THEN 'chosen' ELSE 'prompt' END AS part, turn, role, text
        FROM chosen LEFT JOIN split USING (pair_id)
        UNION ALL
        SELECT pair_id, 'rejected', turn, role, text FROM rejected JOIN split USING (pair_id) WHERE turn >= split)
    SELECT pair_id, part, turn, role,
           '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
           part <> 'prompt' AND coalesce(role = 'assistant', false) AS loss
    FROM rows_"""


def _line_dedup() -> str:
    return f"""
    WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM s),
    k AS (SELECT *, {_low(f"trim(line, {_SPACE})")} AS key FROM l),
    common AS (
        SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN common USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""


_FILTER_AUDIT = r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    f AS (
        SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
               100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
               coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
               EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good,
               EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic FROM d),
    s AS (
        SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
                                         CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails FROM f),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT p.x || q.x || r.x || s.x || u.x AS o FROM letters p, letters q, letters r, letters s, letters u
        WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
    steps AS (SELECT o, step, o[step] AS x FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    placed AS (
        SELECT part, good, toxic, fails, o, coalesce(list_min(list_transform(string_split(fails, ''),
               lambda x: CASE WHEN x = '' THEN NULL ELSE instr(o, x) END)), 9) AS place FROM s, orders),
    counted AS (
        SELECT part, o, step, x, count(*) FILTER (place > step) AS kept, count(*) FILTER (place = step) AS removed,
               count(*) FILTER (place < step AND contains(fails, x)) AS redundant, count(*) FILTER (fails = x) AS unique_fails,
               count(*) FILTER (place = step AND good) AS good_lost, count(*) FILTER (place = step AND toxic) AS toxic_lost
        FROM placed JOIN steps USING (o) GROUP BY part, o, step, x)
    SELECT part, o AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
    FROM counted"""


def _vector_codes() -> str:
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = ""
    for i in range(ROUNDS + 1):
        steps += f""",
    a{i} AS (
        SELECT vec_id, label, p, x, min({{'d': {distance}, 'k': k}}) AS best
        FROM parts JOIN c{i} USING (p) GROUP BY ALL),
    s{i} AS (
        SELECT p, k, place, sum(y)::BIGINT AS s, count(*) AS n
        FROM (SELECT p, best.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY ALL),
    m{i} AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY place) AS moved FROM s{i} GROUP BY ALL),
    c{i + 1} AS (SELECT p, k, coalesce(moved, c) AS c FROM c{i} LEFT JOIN m{i} USING (p, k))"""
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS (SELECT *, len(v) // {PARTS} AS w, unnest(range({PARTS})) AS p FROM kept),
    parts AS (SELECT vec_id, label, p, v[p * w + 1:(p + 1) * w] AS x FROM cut),
    first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < {ENTRIES}),
    c0 AS (SELECT p, k, x AS c FROM parts JOIN first USING (vec_id)){steps},
    coded AS (
        SELECT vec_id, label, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
        FROM a{ROUNDS} GROUP BY ALL),
    books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": _quality_rules(), "op4_url_filters": _url_filters(),
        "op8_preference_format": _PREFERENCE, "op9_line_dedup": _line_dedup(),
        "op12_filter_audit": _FILTER_AUDIT, "op13_vector_codes": _vector_codes(),
    }

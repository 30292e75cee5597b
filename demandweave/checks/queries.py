"""One entry per operator: (session, folder of the given tables) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandweave.checks import payload_texts
from demandweave.checks.standins import AS_OF, DAY, DOCUMENT_ROLES, PART_ROLES, StandIns
from demandweave.functions import dates, json, text
from demandweave.operators import matcher, reconcile, roles
from demandweave.plans import gold, quality, read_model, run, skill_gap
from demandweave.plans.read_model import has_part
from demandweave.session import prepare, shared_folder, spread
from demandweave.sources import catalogs, payloads
from demandweave.sources.warehouse import SERVING, Warehouse

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Callable[[StandIns], DataFrame]] = {}


def _query(build: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    """Register a query under its name (a closing _ keeps a name apart from a module's)."""
    _QUERIES[build.__name__.rstrip("_")] = build
    return build


def plain(df: DataFrame) -> DataFrame:
    """Dates, timestamps and lists as text, so that both engines print them alike."""
    cols = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            col = F.array_join(col, ", ")
        cols.append(col.alias(f.name))
    return df.select(*cols)


def queries() -> dict[str, Query]:
    def bind(build: Callable[[StandIns], DataFrame]) -> Query:
        return lambda spark, folder: plain(build(StandIns(prepare(spark), folder)))

    return {name: bind(build) for name, build in _QUERIES.items()}


def _digest(df: DataFrame, *columns: str) -> DataFrame:
    """Long texts as their MD5."""
    for c in columns:
        df = df.withColumn(c, F.md5(c))
    return df


def _raw_title(postings: DataFrame, path: str) -> DataFrame:
    """The kept JSON of a posting, by what it says under ``path``."""
    return postings.withColumn("raw_title", F.md5(F.get_json_object("raw_json", path))).drop("raw_json")


# --- catalogs and payloads --------------------------------------------------------------


@_query
def src_boards(s: StandIns) -> DataFrame:
    entry = lambda source, token: F.struct(source.alias("source"), token.alias("token"), F.col("s_name").alias("company"))
    name = F.element_at(
        F.array(F.lit(" Greenhouse "), F.lit("LEVER"), F.lit("ashby\t"), F.lit("workday")),
        (F.col("s_suppkey") % 4 + 1).cast("int"),
    )
    board = F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("b"), "s_suppkey")).otherwise("")
    document = F.to_json(F.struct(F.array(entry(name, board), entry(F.lit("Arbeitnow"), F.col("s_name"))).alias("boards")))
    return catalogs.boards_of(s.table("supplier").select("s_suppkey", document.alias("text")), F.col("text"))


@_query
def src_dictionary(s: StandIns) -> DataFrame:
    first = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.array("p_brand").alias("aliases"))
    second = F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("category"),
                      F.lit(None).cast("array<string>").alias("aliases"))
    document = F.to_json(F.struct(F.array(first, second).alias("skills")))
    part = s.table("part").select("p_partkey", document.alias("text"))
    return catalogs.dictionary_of(part, F.col("text"), "p_partkey")


@_query
def src_roles(s: StandIns) -> DataFrame:
    folder = f"{shared_folder(s.spark)}/roles"
    seed = s.table("part").select(F.col("p_type").alias("role"), F.col("p_name").alias("pattern"))
    seed.write.csv(folder, header=True)
    return catalogs.read_roles(s.spark, folder)


@_query
def norm_greenhouse(s: StandIns) -> DataFrame:
    raw = payload_texts.greenhouse(s.documents)
    return _digest(_raw_title(payloads.greenhouse(raw), "$.title"), "description")


@_query
def norm_lever(s: StandIns) -> DataFrame:
    raw = payload_texts.lever(s.documents)
    return _digest(_raw_title(payloads.lever(raw), "$.text"), "description")


@_query
def norm_ashby(s: StandIns) -> DataFrame:
    raw = payload_texts.ashby(s.documents)
    return _digest(_raw_title(payloads.ashby(raw), "$.title"), "description")


@_query
def norm_arbeitnow(s: StandIns) -> DataFrame:
    raw = payload_texts.arbeitnow(s.documents)
    return _digest(_raw_title(payloads.arbeitnow(raw, max_pages=5), "$.title"), "description")


@_query
def norm_paged_feed(s: StandIns) -> DataFrame:
    raw = payload_texts.arbeitnow(s.documents)
    return payloads.feed_pages(raw, max_pages=2).select("seq", "source", "board_token", "page_no")


@_query
def norm_repeated_keys(s: StandIns) -> DataFrame:
    """Keys that stand twice: at the root, in a posting and below it. The last counts."""
    d = F.col("doc_id").cast("string")
    raw = F.concat(
        F.lit('{"meta": 1, "meta": 2, "jobs": [{"id": "a", "id": '), d, F.lit(', "title": "first", "title": "'), "lang",
        F.lit('", "location": {"name": "a", "name": "'), "source", F.lit('"}}, {"id": "x'), d, F.lit('"}]}'))
    return payloads.greenhouse(payload_texts.payload(s.documents, "greenhouse", raw, F.lit(1))).select(
        "seq", "source_job_id", "title", "location")


@_query
def run_unreadable_payload(s: StandIns) -> DataFrame:
    """The payloads of one board are cut off in the second run: the board failed, its jobs stay."""
    warehouse = Warehouse(s.spark, shared_folder(s.spark))
    raw = F.to_json(F.array(F.struct(F.col("doc_id").alias("id"), F.col("text"), F.col("text").alias("descriptionPlain"))))
    boards = s.documents.select(F.lit("lever").alias("source"), F.col("lang").alias("board_token"), F.lit(True).alias("ok"),
                                F.lit(None).cast("string").alias("error")).distinct()
    for n in (1, 2):
        cut = F.when(F.lit(n == 2) & (F.col("lang") == "fr"), F.substring(raw, 1, 30)).otherwise(raw)
        sent = payload_texts.payload(s.documents, "lever", cut, F.lit(None)).withColumn("board_token", F.lower("lang_"))
        run.refresh(warehouse, sent.drop("lang_").withColumn("run_id", F.lit(f"r{n}")), boards.withColumn("run_id", F.lit(f"r{n}")),
                    s.words, DOCUMENT_ROLES, f"r{n}", dt.datetime(2025, 3, n, 6, tzinfo=dt.UTC))
    active = warehouse.read("jobs").agg(F.count_if("is_active").alias("active"))
    return warehouse.read("ingestion_runs").select(
        "run_id", "status", "boards_attempted", "boards_succeeded", "raw_fetched", "jobs_upserted", "jobs_deactivated", "errors",
        active.scalar().alias("active"))


@_query
def schema_defaults(s: StandIns) -> DataFrame:
    """Columns that are left out or NULL come as the defaults of the table."""
    part = s.jobs.drop("is_remote", "apply_url", "is_active").withColumn("description", F.when(F.col("source") == "lever", F.col("description")))
    stored = Warehouse(s.spark, shared_folder(s.spark)).replace("jobs", part)
    return stored.select("job_id", "is_remote", "description", "apply_url", "is_active")


# --- stored tables ----------------------------------------------------------------------


@_query
def bronze_roundtrip(s: StandIns) -> DataFrame:
    warehouse = Warehouse(s.spark, shared_folder(s.spark))
    postings = payloads.lever(payload_texts.lever(s.documents))
    warehouse.land_bronze(postings, "first", AS_OF)
    warehouse.land_bronze(postings.filter("false"), "empty", AS_OF)
    return warehouse.read("bronze").select(
        "run_id", "seq", "source", "board_token", "source_job_id", "fetched_at",
        F.get_json_object("raw_json", "$.createdAt").alias("created"),
    )


@_query
def silver_rewrite(s: StandIns) -> DataFrame:
    warehouse = Warehouse(s.spark, shared_folder(s.spark))
    stored = warehouse.replace("jobs", s.jobs)
    flipped = stored.withColumn("is_active", ~F.col("is_active")).filter("source <> 'lever'")
    return warehouse.replace("jobs", flipped)


@_query
def links_replace_all(s: StandIns) -> DataFrame:
    warehouse = Warehouse(s.spark, shared_folder(s.spark))
    stored = warehouse.replace("job_skills", s.job_skills)
    return warehouse.replace("job_skills", stored.filter("skill <> 'NATION_1'"))


@_query
def links_replace_for(s: StandIns) -> DataFrame:
    touched = s.jobs.filter("location = 'ECONOMY'")
    ids = touched.select("job_id")
    fresh = touched.filter("is_active").select(
        "job_id", F.lit("fresh").alias("skill"), F.lit(None).cast("string").alias("category")
    )
    return matcher.replace_links(s.job_skills, ids, fresh)


@_query
def demand_replace_snapshot(s: StandIns) -> DataFrame:
    warehouse = Warehouse(s.spark, shared_folder(s.spark))
    warehouse.load_history("skill_demand", s.demand)
    warehouse.load_history("skill_trends", gold.skill_trends(s.demand))
    again = s.demand.filter("snapshot_date = date'2024-01-05' and job_count > 1")
    warehouse.replace_snapshot(dt.date(2024, 1, 6), again)
    warehouse.replace_snapshot(dt.date(2024, 1, 7), again.filter("false"))
    both = warehouse.read("skill_demand").select("role", "skill", "category", "job_count", "snapshot_date")
    return both.unionByName(warehouse.read("skill_trends").withColumn("category", F.lit("trends")))


@_query
def serving_export(s: StandIns) -> DataFrame:
    folder = shared_folder(s.spark)
    warehouse = Warehouse(s.spark, f"{folder}/full")
    warehouse.replace("jobs", s.jobs)
    warehouse.replace("job_skills", s.job_skills)
    demand = warehouse.load_history("skill_demand", s.demand)
    warehouse.load_history("skill_trends", gold.skill_trends(demand))
    warehouse.load_history("ingestion_runs", s.runs)
    slim = warehouse.export_serving(f"{folder}/slim")
    shown = {  # key and value of each row
        "jobs": (["job_id"], ["source", "source_job_id", "title", "dedup_hash", F.length("description"), "is_active"]),
        "job_skills": (["job_id", "skill"], ["category"]),
        "skill_demand": (["role", "skill", F.coalesce("category", F.lit("-")), "snapshot_date"], ["job_count"]),
        "skill_trends": (["role", "skill", "snapshot_date"], ["job_count"]),
        "ingestion_runs": (["run_id"], ["started_at", "finished_at"]),
    }
    rows = [slim.read(t).select(F.lit(t).alias("table_name"), _joined(key).alias("key"), _joined(value).alias("value"))
            for t, (key, value) in ((t, shown[t]) for t in SERVING)]
    return functools.reduce(DataFrame.unionByName, rows)


def _joined(columns: list) -> Column:
    return F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


@_query
def run_summary(s: StandIns) -> DataFrame:
    return run.board_summary(s.daily_boards, "run_id")


@_query
def run_audit(s: StandIns) -> DataFrame:
    boards = s.succeeded_boards.select(
        F.lit("r").alias("run_id"), "source", "board_token", (F.col("source") != "ashby").alias("ok"),
        F.when(F.col("source") == "ashby", F.concat(F.lit("ashby/"), "board_token", F.lit(": timeout"))).alias("error"),
    )
    fetched = s.stored(reconcile.with_hash(s.fetched))  # as a run stores its postings
    actions = reconcile.reconcile(s.stored(s.existing), fetched, boards.filter("ok"), AS_OF, 1_000)
    return run.audit_row(boards, fetched, s.stored(actions), "r", "manual", AS_OF, AS_OF)


@_query
def run_error_lines(s: StandIns) -> DataFrame:
    return run.error_lines(s.boards_by_day(2))


@_query
def run_blank_keys(s: StandIns) -> DataFrame:
    """Titles of which a third are written in another script."""
    other = F.translate(F.lower("title"), "abcdefghijklmnopqrstuvwxyz0123456789", "абвгдежзийклмнопрстуфхцчшщабвгдежзийк")
    return run.blank_keys(s.fetched.withColumn("title", F.when(F.col("seq") % 3 == 0, other).otherwise(F.col("title"))))


# --- column expressions -----------------------------------------------------------------


@_query
def strip_html_pages(s: StandIns) -> DataFrame:
    return spread(s.table("pages"), "page_id").select("page_id", text.strip_html(F.col("html")).alias("plain_text"))


@_query
def normalize_key(s: StandIns) -> DataFrame:
    return s.documents.select("doc_id", F.md5(text.normalize_for_key(F.col("text"))).alias("key_md5"))


@_query
def dedup_hash(s: StandIns) -> DataFrame:
    place = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" ("), "source", F.lit(") ")))
    h = text.dedup_hash(F.upper("lang"), F.col("text"), place)
    return s.documents.select("doc_id", h.alias("dedup_hash"))


@_query
def job_id(s: StandIns) -> DataFrame:
    return s.table("documents").select(
        "doc_id", text.make_job_id(F.col("source"), F.col("doc_id").cast("string")).alias("job_id")
    )


@_query
def surrogate_keys(s: StandIns) -> DataFrame:
    part = F.when(F.col("p_size") > 10, F.col("p_brand"))
    return s.table("part").select(
        "p_partkey", text.surrogate_key(part).alias("one"), text.surrogate_key(F.col("p_partkey"), part).alias("two")
    )


@_query
def looks_remote(s: StandIns) -> DataFrame:
    place = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(" (ReMote)"))).when(
        F.col("p_size") % 3 == 1, F.col("p_type"))
    return s.table("part").select("p_partkey", text.looks_remote(place).alias("remote"))


@_query
def parse_iso(s: StandIns) -> DataFrame:
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = s.table("events").withColumn("v", F.col("event_id") % 10)
    written = (
        F.when(F.col("v") == 0, F.concat(ts, F.lit("Z")))
        .when(F.col("v") == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(F.col("v") == 2, F.concat(ts, F.lit("+05:30")))
        .when(F.col("v") == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("v") == 4, F.date_format("ts", "yyyyMMdd'T'HHmmss"))
        .when(F.col("v") == 5, F.date_format("ts", "yyyy-MM"))
        .when(F.col("v") == 6, F.lit("tomorrow"))
        .when(F.col("v") == 7, F.lit(""))
        .when(F.col("v") == 8, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit("-0300")))
    )
    return e.select("event_id", dates.parse_iso(written).alias("parsed"))


@_query
def epoch_time(s: StandIns) -> DataFrame:
    n = F.unix_seconds(F.col("ts").cast("timestamp"))
    return s.table("events").select(
        "event_id", dates.from_epoch_ms(n * 1000 + F.col("event_id") % 1000).alias("from_ms"),
        dates.from_epoch_seconds(n).alias("from_s"),
    )


@_query
def json_typed_access(s: StandIns) -> DataFrame:
    doc = F.concat(
        F.lit('{"a": '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .otherwise(F.col("event_id").cast("string")),
        F.lit(', "b": '), F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, '"true"')
        .otherwise("null"),
        F.lit(', "c": '), F.when(F.col("event_id") % 5 == 0, '"x"').otherwise(F.col("props")), F.lit("}"),
    )
    v = s.table("events").select("event_id", F.try_parse_json(doc).alias("v"))
    return v.select(
        "event_id", json.get_str(F.col("v"), "$.a").alias("a"), json.get_bool(F.col("v"), "$.b").alias("b"),
        json.get_int(json.get_child(F.col("v"), "$.c"), "$.k").alias("k"),
    )


@_query
def json_get_id(s: StandIns) -> DataFrame:
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 7
    value = (
        F.when(kind == 0, n).when(kind == 1, F.concat(F.lit('"e-'), n, F.lit('"')))
        .when(kind == 2, F.concat(n, F.lit(".0"))).when(kind == 3, F.concat(n, F.lit(".50")))
        .when(kind == 4, F.lit("true")).when(kind == 5, F.concat(n, F.lit("e2"))).otherwise(F.lit("[1]"))
    )
    doc = F.concat(F.lit('{"id": '), value, F.lit("}"))
    v = s.table("events").select("event_id", F.try_parse_json(doc).alias("v"))
    return v.select("event_id", json.get_id(F.col("v"), "$.id").alias("id"))


# --- skill extraction -------------------------------------------------------------------


@_query
def dictionary_terms(s: StandIns) -> DataFrame:
    skills = s.table("part").select(
        F.col("p_partkey").alias("skill_id"), F.concat(F.lit(" "), "p_name").alias("name"),
        F.col("p_type").alias("category"), F.array(F.col("p_brand"), F.lit(""), F.upper("p_type")).alias("aliases"),
    )
    return matcher.term_table(skills)


@_query
def skill_match(s: StandIns) -> DataFrame:
    return s.texts.select("job_id", F.array_sort(s.words.skill_ids(F.col("description"))).alias("ids"))


@_query
def skill_match_guarded(s: StandIns) -> DataFrame:
    return s.texts.select("job_id", F.array_sort(s.guarded_words.skill_ids(F.col("description"))).alias("ids"))


# Titles that trip the default guards, or nearly; ``oracle`` says which skills they name.
GUARDED_TITLES = (
    "We write Go", "you go first", "our go-to-market plan", "the go-live date", "a Series C round", "C-level staff", "the C suite",
    "C's best", "R&D office", "R$ 5,000", "in C and R", "x. golang",
)


@_query
def links_default_guards(s: StandIns) -> DataFrame:
    """A dictionary file, its matcher with the default guards, and links over documents and conversations."""
    folder = f"{shared_folder(s.spark)}/skills"
    entries = [("Go", "Language", ["golang"]), ("C", "Language", []), ("R", "Language", []), ("Joint", "Word", ["and", "und", "et"])]
    skills = s.spark.createDataFrame(entries, "name string, category string, aliases array<string>")
    document = skills.agg(F.to_json(F.struct(F.collect_list(F.struct("name", "category", "aliases")).alias("skills"))).alias("value"))
    document.write.text(folder)
    ready = matcher.SkillMatcher.from_dictionary(catalogs.read_dictionary(s.spark, folder))
    said = s.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), F.lit("c").alias("kind"), "text")
    texts = s.documents.select(F.col("doc_id").alias("n"), F.lit("d").alias("kind"), "text").unionByName(said)
    titles = F.array(*[F.lit(t) for t in GUARDED_TITLES])
    postings = texts.select(
        F.concat("kind", "n").alias("job_id"), F.get(titles, (F.col("n") % len(GUARDED_TITLES)).cast("int")).alias("title"),
        F.col("text").alias("description"))
    return matcher.extract_links(postings, ready)


@_query
def extract_links(s: StandIns) -> DataFrame:
    return matcher.extract_links(s.texts, s.words)


@_query
def texts_for_ids(s: StandIns) -> DataFrame:
    ids = s.table("labels").filter("toxic = 0").select(F.col("doc_id").cast("string").alias("job_id"))
    return _digest(matcher.texts_for(s.texts, ids), "title", "description")


@_query
def extract_incremental(s: StandIns) -> DataFrame:
    ids = s.table("labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("job_id"))
    old = s.texts.select("job_id", F.lit("old").alias("skill"), F.lit(None).cast("string").alias("category"))
    return matcher.reextract(s.texts, old, ids, s.words)


@_query
def user_skill_parse(s: StandIns) -> DataFrame:
    said = s.table("conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("user_id"), "text"
    )
    return read_model.parse_user_skills(said, s.words)


@_query
def resolve_skill_dictionary(s: StandIns) -> DataFrame:
    asked = s.table("conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return read_model.resolve_by_dictionary(asked, s.words, 3).select("conv_id", "turn", "matches")


@_query
def resolve_tool(s: StandIns) -> DataFrame:
    """By the dictionary, or else by the observed names."""
    nation = s.table("nation").select("n_nationkey", "n_name")
    query = F.when(F.col("c_custkey") % 3 == 0, F.lower("n_name")).when(
        F.col("c_custkey") % 3 == 1, F.concat("c_mktsegment", F.lit(" and is"))).otherwise(F.substring("n_name", 3, 5))
    asked = s.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", query.alias("query"))
    return read_model.resolve(asked, s.words, s.job_skills).select("c_custkey", "query", "matches")


# --- reconciliation ---------------------------------------------------------------------


@_query
def run_dedup(s: StandIns) -> DataFrame:
    return reconcile.run_dedup(s.fetched).select("source", "source_job_id", "seq", "title")


@_query
def reconcile_decisions(s: StandIns) -> DataFrame:
    first = reconcile.with_hash(reconcile.run_dedup(s.stored(s.fetched)))
    return reconcile.decide(first, s.stored(s.existing), 100).select("source", "source_job_id", "seq", "decision")


def _reconciled(s: StandIns) -> DataFrame:
    existing, fetched = s.stored(s.existing), s.stored(s.fetched)
    return reconcile.reconcile(existing, fetched, s.succeeded_boards, AS_OF, 1_000)


@_query
def reconcile_(s: StandIns) -> DataFrame:
    return reconcile.jobs_of(_reconciled(s))


@_query
def reconcile_deactivate(s: StandIns) -> DataFrame:
    return _reconciled(s).filter("action = 'deactivate'").select("job_id", "is_active", "last_seen_at")


@_query
def reconcile_counts(s: StandIns) -> DataFrame:
    return reconcile.action_counts(_reconciled(s))


# --- star schema ------------------------------------------------------------------------


@_query
def stg_jobs(s: StandIns) -> DataFrame:
    return gold.stg_jobs(s.jobs)


@_query
def stg_job_skills(s: StandIns) -> DataFrame:
    return gold.stg_job_skills(s.raw_links)


@_query
def fact_job_posting(s: StandIns) -> DataFrame:
    return gold.fact_job_posting(s.jobs)


@_query
def fact_job_skill(s: StandIns) -> DataFrame:
    return gold.fact_job_skill(gold.fact_job_posting(s.jobs), gold.stg_job_skills(s.raw_links))


@_query
def posting_roles(s: StandIns) -> DataFrame:
    return roles.posting_roles(gold.fact_job_posting(s.jobs), PART_ROLES)


@_query
def posting_roles_table(s: StandIns) -> DataFrame:
    """A seed table of as many rows as there are parts."""
    seed = s.table("part").select(F.col("p_brand").alias("role"), F.col("p_partkey").cast("string").alias("pattern"))
    titles = s.table("customer").select(F.col("c_custkey").cast("string").alias("job_id"), F.lower("c_name").alias("title_lower"))
    return roles.posting_roles(titles, seed)


@_query
def dim_company(s: StandIns) -> DataFrame:
    return gold.dim_company(s.jobs)


@_query
def dim_skill(s: StandIns) -> DataFrame:
    return gold.dim_skill(s.jobs, gold.stg_job_skills(s.raw_links))


@_query
def dim_role(s: StandIns) -> DataFrame:
    return gold.dim_role(s.jobs.select(F.col("title").alias("role")))


@_query
def dim_date(s: StandIns) -> DataFrame:
    return gold.dim_date(s.jobs, AS_OF)


@_query
def skill_demand(s: StandIns) -> DataFrame:
    return gold.skill_demand(s.jobs, s.job_skills, PART_ROLES, DAY)


@_query
def skill_trends(s: StandIns) -> DataFrame:
    return gold.skill_trends(s.demand)


# --- read model -------------------------------------------------------------------------


@_query
def scan_active_jobs(s: StandIns) -> DataFrame:
    return read_model.active_jobs(s.jobs)


@_query
def market_overview(s: StandIns) -> DataFrame:
    return read_model.market_overview(s.jobs, s.job_skills, s.runs)


@_query
def list_roles(s: StandIns) -> DataFrame:
    return read_model.roles_latest(s.demand)


@_query
def distinct_lists(s: StandIns) -> DataFrame:
    skills = read_model.distinct_skills(s.job_skills).select(F.lit("skill").alias("kind"), F.col("skill").alias("value"))
    return skills.unionByName(
        read_model.distinct_sources(s.jobs).select(F.lit("source").alias("kind"), F.col("source").alias("value"))
    )


@_query
def role_total(s: StandIns) -> DataFrame:
    return read_model.role_total(s.jobs, "Fastener", PART_ROLES)


@_query
def role_totals(s: StandIns) -> DataFrame:
    return read_model.role_totals(s.jobs, PART_ROLES)


@_query
def demand_latest(s: StandIns) -> DataFrame:
    return read_model.demand(s.demand, "click", 10)


def _part_demand(s: StandIns) -> DataFrame:
    return s.stored(gold.skill_demand(s.jobs, s.job_skills, PART_ROLES, DAY))


@_query
def top_skills_share(s: StandIns) -> DataFrame:
    return read_model.top_skills(_part_demand(s), s.jobs, "Fastener", PART_ROLES)


@_query
def trends_topn(s: StandIns) -> DataFrame:
    return read_model.trends(s.demand, "view", 5)


@_query
def trend_days(s: StandIns) -> DataFrame:
    return read_model.trend_days(s.demand, "view", 5)


@_query
def companies_hiring(s: StandIns) -> DataFrame:
    return read_model.companies_hiring(s.jobs, s.job_skills, "NATION_3")


@_query
def jobs_with_skill(s: StandIns) -> DataFrame:
    return read_model.having_skill(s.jobs, s.job_skills, "NATION_7").select("job_id", "title", "is_active")


@_query
def filter_substring(s: StandIns) -> DataFrame:
    conditions = [has_part("company", "BRAND#1"), has_part("location", "o"), has_part("title", "Red")]
    return read_model.filter_jobs(s.jobs, s.job_skills, *conditions).select("job_id", "company", "location", "title")


@_query
def filter_remote(s: StandIns) -> DataFrame:
    remote = read_model.filter_jobs(s.jobs, s.job_skills, F.col("is_remote"), F.col("source") == "lever")
    on_site = read_model.filter_jobs(s.jobs, s.job_skills, ~F.col("is_remote"), F.col("source") == "ashby")
    return remote.unionByName(on_site).select("job_id", "source", "is_remote")


@_query
def job_count(s: StandIns) -> DataFrame:
    return read_model.job_count(s.jobs, s.job_skills, has_part("title", "ring"), skill="NATION_3")


@_query
def find_jobs(s: StandIns) -> DataFrame:
    return read_model.find_jobs(s.jobs, s.job_skills, has_part("title", "ring"), skill="NATION_3", limit=40)


@_query
def jobs_page(s: StandIns) -> DataFrame:
    _, offset = read_model.page_offset(60, 2)
    return read_model.jobs_page(s.jobs, s.job_skills, has_part("title", "ring"), offset=offset)


@_query
def jobs_page_after(s: StandIns) -> DataFrame:
    """The second page, found from the last entry of the first."""
    ring = has_part("title", "ring")
    last = read_model.jobs_page(s.jobs, s.job_skills, ring).select(*read_model.DISPLAY).collect()[-1]
    return read_model.jobs_page(s.jobs, s.job_skills, ring, after=last.asDict(), limit=read_model.PAGE_SIZE)


@_query
def resolve_skill(s: StandIns) -> DataFrame:
    return read_model.resolve_skill(s.job_skills, "Nation_1")


# --- skill gap --------------------------------------------------------------------------


def _leaders(s: StandIns) -> DataFrame:
    return skill_gap.leaders(_part_demand(s), read_model.role_totals(s.jobs, PART_ROLES), 20)


def _gap(s: StandIns) -> DataFrame:
    return skill_gap.skill_gap(s.user_skills, _leaders(s))


@_query
def skill_gap_(s: StandIns) -> DataFrame:
    return _gap(s)


@_query
def skill_gap_coverage(s: StandIns) -> DataFrame:
    return skill_gap.coverage(s.user_skills, _leaders(s))


@_query
def gap_top8(s: StandIns) -> DataFrame:
    return skill_gap.plan_list(_gap(s))


# --- data checks ------------------------------------------------------------------------


@_query
def dq_not_null(s: StandIns) -> DataFrame:
    return quality.not_null(s.jobs, ["job_id", "source", "dedup_hash", "is_active", "posted_at"])


@_query
def dq_unique(s: StandIns) -> DataFrame:
    return quality.unique(s.jobs, "job_id").unionByName(quality.unique(s.jobs, "dedup_hash"))


@_query
def dq_unique_combo(s: StandIns) -> DataFrame:
    return quality.unique_combination(s.raw_links, ["job_id", "skill"])


@_query
def dq_accepted(s: StandIns) -> DataFrame:
    return quality.accepted_values(s.raw_links, "category", ["AFRICAA", "AFRICAN", "ASIAR"])


@_query
def dq_relationships(s: StandIns) -> DataFrame:
    facts = gold.fact_job_posting(s.jobs)
    links = s.raw_links.select("job_id")
    return quality.relationships(links, "job_id", facts, "job_id").unionByName(
        quality.relationships(facts, "company_key", gold.dim_company(s.jobs), "company_key")
    )


@_query
def dq_freshness(s: StandIns) -> DataFrame:
    return quality.freshness(s.jobs, "last_seen_at", dt.datetime(2024, 5, 25, tzinfo=dt.UTC))


@_query
def dq_models(s: StandIns) -> DataFrame:
    """The declared checks over stored models, built from the links with repeats and NULLs."""
    skills = s.stored(gold.stg_job_skills(s.raw_links))
    facts = s.stored(gold.fact_job_posting(s.jobs))
    seed = s.spark.createDataFrame(PART_ROLES, "role string, pattern string")
    demand = s.stored(gold.skill_demand(s.jobs, skills, PART_ROLES, DAY))
    return quality.check_models({
        "stg_jobs": s.stored(gold.stg_jobs(s.jobs)), "stg_job_skills": skills,
        "dim_date": s.stored(gold.dim_date(s.jobs, AS_OF)), "dim_company": s.stored(gold.dim_company(s.jobs)),
        "dim_skill": s.stored(gold.dim_skill(s.jobs, skills)), "dim_role": gold.dim_role(seed),
        "fact_job_posting": facts, "fact_job_skill": s.stored(gold.fact_job_skill(facts, skills)),
        "skill_demand": demand, "skill_trends": gold.skill_trends(demand), "seed_roles": seed,
    })


# --- the full run -----------------------------------------------------------------------


@_query
def full_run(s: StandIns) -> DataFrame:
    """Three runs over payloads of all vendors: a board fails in the second, and the third
    replaces the second's snapshot of the same day."""
    warehouse = Warehouse(s.spark, shared_folder(s.spark))
    docs = s.documents
    runs = [
        ("d1", 1, "source not in ('src1', 'src2', 'src3')"), ("d2", 2, "source <> 'src5'"),
        ("d3", 2, "source not in ('src5', 'src9', 'src14')"),
    ]
    own_token = F.when(F.col("source") == "arbeitnow", "arbeitnow").otherwise(F.col("lang"))
    boards = docs.select(_vendor(), "lang").select("source", own_token.alias("board_token")).distinct()
    for run_id, day, listed in runs:
        failed = F.lit(run_id == "d2") & (F.col("source") == "lever") & (F.col("board_token") == "fr")
        status = boards.select(
            F.lit(run_id).alias("run_id"), "*", (~failed).alias("ok"), F.when(failed, F.lit("lever/fr: 503")).alias("error")
        )
        raw = _vendor_payloads(docs.filter(listed)).withColumn("run_id", F.lit(run_id))
        now = dt.datetime(2025, 3, day, 6, tzinfo=dt.UTC)
        run.refresh(warehouse, raw, status, s.words, DOCUMENT_ROLES, run_id, now)
    day = F.dayofmonth("snapshot_date")
    lines = warehouse.read("run_errors")
    return functools.reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), _joined(key).alias("key"), _joined(value).alias("value")) for kind, df, key, value in (
        ("run", warehouse.read("ingestion_runs"), ["run_id"], [
            "status", "boards_attempted", "boards_succeeded", "raw_fetched", "jobs_upserted", "jobs_deactivated", "errors"]),
        ("error", lines, ["run_id", "source", "board_token"], ["error"]),
        ("job", warehouse.read("jobs"), ["job_id"], ["source", "source_job_id", "board_token", "is_active", F.dayofmonth("first_seen_at"), F.dayofmonth("last_seen_at")]),
        ("link", warehouse.read("job_skills"), ["job_id", "skill"], ["category"]),
        ("demand", warehouse.read("skill_demand"), ["role", "skill", day], ["job_count"]),
        ("trend", warehouse.read("skill_trends"), ["role", "skill", day], ["job_count"]),
    )])


def _vendor():
    kinds = F.array(*[F.lit(v) for v in ("greenhouse", "lever", "ashby", "arbeitnow")])
    return F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("source")


def _vendor_payloads(docs: DataFrame) -> DataFrame:
    """One posting per payload in the format of the document's vendor."""
    title = F.col("text")
    of_vendor = {
        0: F.to_json(F.struct(F.array(F.struct(
            F.col("doc_id").alias("id"), title.alias("title"), F.col("lang").alias("company_name"),
            F.col("text").alias("content"))).alias("jobs"))),
        1: F.to_json(F.array(F.struct(
            F.col("doc_id").alias("id"), title.alias("text"), F.col("text").alias("descriptionPlain")))),
        2: F.to_json(F.struct(F.array(F.struct(
            F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("descriptionPlain"))).alias("jobs"))),
        3: F.to_json(F.struct(F.array(F.struct(
            F.col("doc_id").cast("string").alias("slug"), title.alias("title"), F.col("lang").alias("company_name"),
            F.col("text").alias("description"))).alias("data"))),
    }
    raw = None
    for vendor, doc in of_vendor.items():
        here = F.col("doc_id") % 4 == vendor
        raw = F.when(here, doc) if raw is None else raw.when(here, doc)
    return docs.select(
        F.col("doc_id").alias("seq"), _vendor(),
        F.when(F.col("doc_id") % 4 == 3, "global").otherwise(F.col("lang")).alias("board_token"),
        F.lit(1).alias("page_no"), F.lit(None).cast("timestamp").alias("fetched_at"), raw.alias("raw_json"),
    )

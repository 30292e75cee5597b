"""Raw payloads as JSON text, derived from documents: well-formed postings beside odd ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wrapped(text: Column) -> Column:
    """Entity-encoded HTML around the text."""
    return F.concat(F.lit("&lt;p class=&quot;x&quot;&gt;"), text, F.lit("&lt;/p&gt;<br/>\n&nbsp;&#8364;&eacute;"))


def _iso(doc_id: Column, suffix: str) -> Column:
    day = F.lpad((doc_id % 28 + 1).cast("string"), 2, "0")
    hour = F.lpad((doc_id % 24).cast("string"), 2, "0")
    return F.concat(F.lit("2024-02-"), day, F.lit("T"), hour, F.lit(":30:00" + suffix))


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def payload(documents: DataFrame, source: str, raw: Column, page_no: Column) -> DataFrame:
    """Payloads of a vendor, with the language of the document beside them."""
    return documents.select(
        F.col("doc_id").alias("seq"), F.lit("r1").alias("run_id"), F.lit(source).alias("source"),
        F.col("source").alias("board_token"), page_no.cast("int").alias("page_no"),
        F.lit(None).cast("timestamp").alias("fetched_at"), raw.alias("raw_json"), F.col("lang").alias("lang_"),
    )


def _payload(documents: DataFrame, source: str, text: Column, page_no: Column) -> DataFrame:
    """Beside the good payloads some are cut off or followed by text (no JSON), and some have another root."""
    d = F.col("doc_id")
    bad = F.when(d % 19 == 0, F.substring(text, 1, 30)).when(d % 23 == 0, F.concat(text, F.lit(" trailing"))).otherwise('"text"')
    odd = documents.filter((d % 19 == 0) | (d % 23 == 0) | (d % 17 == 0))
    good = payload(documents, source, text, page_no)
    return good.unionByName(payload(odd, source, bad, page_no).withColumn("seq", F.col("seq") + 50_000_000)).drop("lang_")


def greenhouse(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    place = F.when(F.col("lang") == "en", F.concat(F.lit("REMOTE, "), "source")).otherwise(F.col("source"))
    good = F.to_json(F.struct(
        d.alias("id"), F.col("text").alias("title"), F.struct(place.alias("name")).alias("location"),
        F.when(d % 3 == 0, "  ").otherwise(F.col("lang")).alias("company_name"),
        _wrapped(F.col("text")).alias("content"), F.concat(F.lit("https://b.example/"), d).alias("absolute_url"),
        F.when(d % 2 == 0, "").otherwise(_iso(d, "+02:00")).alias("updated_at"),
        _iso(d, "Z").alias("first_published"),
    ))
    plain = F.to_json(F.struct(F.concat(F.lit("x"), d).alias("id"), F.lit("Remote").alias("location")))
    odd = F.lit('{"id": true, "title": "t"}, {"title": "no id"}, {"id": ""}, 7, null')
    text = F.concat(F.lit('{"meta": {}, "jobs": '), _list(good, odd, plain), F.lit("}"))
    return _payload(documents, "greenhouse", text, F.lit(1))


def lever(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    good = F.to_json(F.struct(
        F.concat(F.lit("l"), d).alias("id"), F.col("text").alias("text"),
        F.struct(F.col("source").alias("location"), F.when(d % 2 == 0, "Full-time (remote)").alias("commitment"))
        .alias("categories"),
        F.when(d % 3 == 0, " \n").otherwise(F.col("text")).alias("descriptionPlain"),
        _wrapped(F.col("text")).alias("description"),
        F.when(d % 5 == 0, "Remote").otherwise("hybrid").alias("workplaceType"),
        F.when(d % 4 == 0, "").otherwise("https://h.example").alias("hostedUrl"),
        F.lit("https://a.example").alias("applyUrl"),
        (F.lit(1_704_067_200_000) + d * 1_001).alias("createdAt"),
    ))
    odd = F.lit('{"id": 12.5, "createdAt": "2024", "categories": "Remote"}')
    return _payload(documents, "lever", _list(good, odd), F.lit(1))


def ashby(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    good = F.to_json(F.struct(
        F.concat(F.lit("a"), d).alias("id"), F.col("text").alias("title"),
        F.col("source").alias("location"), (d % 2 == 0).alias("isRemote"),
        F.when(d % 3 == 0, "").otherwise(F.col("text")).alias("descriptionPlain"),
        _wrapped(F.col("text")).alias("descriptionHtml"),
        F.when(d % 4 == 0, "https://j.example").alias("jobUrl"), F.lit("https://a.example").alias("applyUrl"),
        _iso(d, ".250Z").alias("publishedAt"),
    ))
    odd = F.lit('{"id": 3.0, "isRemote": "yes", "publishedAt": "2024-02"}')
    text = F.concat(F.lit('{"jobs": '), _list(good, odd), F.lit("}"))
    return _payload(documents, "ashby", text, F.lit(1))


def arbeitnow(documents: DataFrame) -> DataFrame:
    """Five pages per feed, one feed per five documents; some pages name no next page."""
    d = F.col("doc_id")
    good = F.to_json(F.struct(
        F.concat(F.lit("s"), d).alias("slug"), F.when(d % 3 == 0, " ").otherwise(F.col("lang")).alias("company_name"),
        F.col("text").alias("title"), F.col("source").alias("location"), (d % 2 == 0).alias("remote"),
        _wrapped(F.col("text")).alias("description"), F.concat(F.lit("https://f.example/"), d).alias("url"),
        (F.lit(1_704_067_200) + d).alias("created_at"),
    ))
    follow = F.when(d % 7 == 0, F.lit('"next": null')).otherwise(F.lit('"next": "https://f.example/?page"'))
    text = F.concat(F.lit('{"data": '), _list(good), F.lit(', "links": {'), follow, F.lit("}}"))
    pages = _payload(documents, "arbeitnow", text, d % 5 + 1)
    return pages.withColumn("board_token", F.floor(F.col("seq") / 5).cast("string"))

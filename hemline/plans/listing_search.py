"""The listing search plan: result pages of many queries to one report per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.functions import text as T
from hemline.operators.listings import enrich_top, render_listing_report
from hemline.operators.pages import extract_details, extract_listings
from hemline.operators.scale import first_n
from hemline.session import stored

ORDER = ["page_no", "pos"]


def search_listings(pages: DataFrame) -> DataFrame:
    """Listings of all result pages (page_id, query, page_no, url, html) with their query and place."""
    found = extract_listings(pages, carry=["query", "page_no"])
    return found.withColumn(
        "listing_id", F.concat_ws("-", F.col("page_id").cast("string"), F.col("pos").cast("string"))
    )


def _contact(details):
    """Value of the detail named contact, in any case."""
    named = F.filter(F.map_entries(details), lambda e: F.lower(e["key"]) == "contact")
    return F.get(named, F.lit(0))["value"]


def listing_reports(
    requests: DataFrame, pages: DataFrame, details: DataFrame, base: str, top: int = 5, contacts: int = 3
) -> DataFrame:
    """Report per request (query, city, ad_type): the first listings, contacts for the first few, what remains.

    ``details`` are the fetched detail pages (page_id, url, html); only those of the first ``contacts`` listings
    are matched. The total is the one stated on the earliest page that states any. Requests that name no city, or only a
    placeholder for one, are answered with the question for it.
    """
    asked = requests.select(
        "query", T.city_slug(T.null_if_placeholder(F.col("city"))).alias("city"), T.media_types(F.col("ad_type")).alias("types")
    )
    # pages are parsed once; ranking, totals and the report all read the far smaller listings
    found = stored(search_listings(pages), "listings")
    totals = found.filter("total_found IS NOT NULL").groupBy("query").agg(
        F.min_by("total_found", "page_no").alias("total_found")
    )
    queries = asked.join(totals, "query", "left").select(
        "query",
        "city",
        F.array_join("types", ", ").alias("ad_type"),
        "total_found",
        T.search_url(F.col("city"), F.col("types"), F.lit(1), base).alias("search_url"),
    )
    # only the detail pages of the first listings are worth parsing
    wanted = first_n(found, ["query"], ORDER, contacts).select(F.col("detail_url").alias("url")).distinct()
    known = extract_details(details.join(wanted, "url", "left_semi").select("page_id", "url", "html")).select(
        "detail_url", _contact(F.col("details")).alias("contact")
    )
    listings = enrich_top(found, known, ["query"], ORDER, contacts, "listing_id", "detail_url", "contact")
    return render_listing_report(listings, queries, ORDER, top)

"""Rows from web pages, posts, sidecar files and media listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom import schemas as S
from tierloom.functions.text import label_from_file, strip, strip_html, video_id


def _first(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def articles_of_posts(posts: DataFrame, column: str = "json") -> DataFrame:
    """Article rows of post JSON: title, text, day, video id and categories."""
    rows = posts.select(F.from_json(column, S.POST).alias("p")).filter("p.id is not null")
    html = F.coalesce(F.col("p.content.rendered"), F.lit(""))
    return rows.select(
        F.col("p.id").alias("post_id"), strip_html(F.coalesce("p.title.rendered", F.lit(""))).alias("title"),
        F.substring(F.coalesce("p.date", F.lit("")), 1, 10).alias("date"), F.coalesce("p.slug", F.lit("")).alias("slug"),
        video_id(html).alias("youtube_id"), strip_html(html).alias("text"), F.coalesce("p.link", F.lit("")).alias("url"),
        F.array_join(F.transform(F.coalesce("p.categories", F.expr("array()").cast("array<bigint>")), lambda c: c.cast("string")), ",").alias("categories"))


def sidecar_rows(files: DataFrame, column: str = "json") -> DataFrame:
    """Video facts of sidecar JSON; unreadable files give empty facts."""
    rows = files.withColumn("_s", F.from_json(column, S.SIDECAR, {"mode": "PERMISSIVE"}))
    rest = [c for c in files.columns if c != column]
    s = F.col("_s")
    return rows.select(
        *rest, F.coalesce(s["id"], F.lit("")).alias("id"), F.coalesce(s["title"], F.lit("(unknown)")).alias("title"),
        F.substring(F.coalesce(s["description"], F.lit("")), 1, 500).alias("description"),
        F.coalesce(s["uploader"], F.lit("")).alias("uploader"), F.coalesce(s["upload_date"], F.lit("")).alias("upload_date"),
        s["duration"].alias("duration_sec"),
        F.coalesce(F.nullif(s["webpage_url"], F.lit("")), s["url"], F.lit("")).alias("source_url"))


def dictionary_entries(pages: DataFrame, video_folder: str, tag: str, html: str = "html") -> DataFrame:
    """Dictionary entries of detail pages that mention the video folder.

    ``video_folder`` is the path part before a video file; ``tag`` names entries without a title.
    """
    page = F.col(html)
    videos = F.regexp_extract_all(page, F.lit(rf'({video_folder}/[^"]+\.mp4)'), F.lit(1))
    codes = F.regexp_extract_all(page, F.lit(r'fsw/sign/png/([^"]+?)-CG_white_'), F.lit(1))
    name = F.coalesce(_first(page, r'class="entry-name[^"]*"[^>]*>([^<]+)'), _first(page, r"<h2[^>]*>([^<]+)</h2>"))
    rest = [c for c in pages.columns if c != html]
    return pages.filter(page.contains(video_folder)).select(
        *rest, F.coalesce(strip(name), F.concat(F.lit(f"{tag}-"), F.col("id").cast("string"))).alias("name"),
        F.coalesce(strip(_first(page, r"translate-text[^>]*>([^<]+)")), F.lit("")).alias("translation"),
        videos.alias("videos"), codes.alias("fsw_codes"))


def sign_page_facts(pages: DataFrame, site: str = "", html: str = "html", slug: str = "slug") -> DataFrame:
    """Video ids (players, then thumbnails), title and hand shapes of sign pages."""
    page = F.col(html)
    players = F.regexp_extract_all(page, F.lit(r'youtube\.com/embed/([^?"&]+)'), F.lit(1))
    thumbs = F.regexp_extract_all(page, F.lit(r'img\.youtube\.com/vi/([^/"]+)'), F.lit(1))
    title = _first(page, r'og:title.*?content="([^"]+)"')
    rest = [c for c in pages.columns if c != html]
    return pages.select(
        *rest, F.array_distinct(F.concat(players, thumbs)).alias("youtube_ids"),
        F.coalesce(strip(F.replace(title, F.lit(f" - {site}"), F.lit(""))), F.col(slug)).alias("title"),
        F.regexp_extract_all(page, F.lit(r'src="(/_images/tvaryruky/[^"]+)"'), F.lit(1)).alias("hand_shapes"))


def listing_links(pages: DataFrame, pattern: str = r'href="(/([^/]+)/posunok-(\d+)/)"', html: str = "html",
                  order: str = "page_id") -> DataFrame:
    """Links of listing pages: slug, id, href; the first mention per (slug, id) wins."""
    def group(i: int) -> Column:
        return F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(i))

    links = F.arrays_zip(group(1).alias("href"), group(2).alias("slug"), group(3).alias("id"))
    rows = pages.select(F.col(order), F.posexplode(links).alias("place", "l"))
    return rows.groupBy("l.slug", "l.id").agg(F.min(F.struct(order, "place", "l.href")).alias("m")).select(
        "slug", "id", F.col("m.href").alias("href"), F.col(f"m.{order}").alias("first_page"))


def media_metadata(listings: DataFrame, source: str, keep, folder: str, files: DataFrame, column: str = "json") -> DataFrame:
    """Metadata of listed videos that pass ``keep`` (a rule on the file name), and whether the file is there."""
    rows = listings.select(F.explode(F.from_json(column, S.MEDIA)).alias("m"))
    rows = rows.select(F.regexp_extract("m.source_url", r"([^/]*)$", 1).alias("filename"), F.col("m.source_url").alias("url"),
                       F.coalesce("m.title.rendered", F.lit("")).alias("_title")).filter(keep(F.col("filename")))
    there = files.select("filename").distinct().withColumn("present", F.lit(True))
    return rows.join(there, "filename", "left").select(
        F.lit(source).alias("source"), "filename", label_from_file("filename", F.lit(source), "_title").alias("label"), "url",
        F.concat(F.lit(f"{folder}/{source}/"), "filename").alias("path"), F.coalesce("present", F.lit(False)).alias("present"))

"""Crawled pages: titles, text, fields, links, breadcrumbs and a wave-wise crawl."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other words for the same toy, and words that are none.
TOY_ALIASES = {"滑り台": "すべり台", "スベリ台": "すべり台", "鉄ぼう": "鉄棒", "すな場": "砂場"}


def unescaped(text: Column) -> Column:
    """Character references decoded: decimal and hexadecimal ones, and the named ones of HTML 4."""
    names = F.create_map(*[F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (f"&{name};", chr(code))])

    def char(ref: Column) -> Column:
        code = F.when(ref.rlike("^&#[xX]"), F.lower(F.regexp_extract(ref, "^&#[xX]0*([0-9a-fA-F]{1,6});$", 1))).when(ref.startswith("&#"), F.lower(F.hex(F.regexp_extract(ref, "^&#([0-9]{1,7});$", 1).try_cast("long"))))
        known = F.conv(code, 16, 10).try_cast("long").between(1, 0x10FFFF)
        return F.coalesce(F.when(known, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")), F.try_element_at(names, ref), ref)

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"), F.lit(0)))
    # What gives an ampersand goes last, so that nothing is decoded twice.
    late = lambda r: r.rlike("^&(?:amp|#0*38|#[xX]0*26);$")
    ordered = F.concat(F.filter(refs, lambda r: ~late(r)), F.filter(refs, late))
    return F.aggregate(ordered, text, lambda acc, ref: F.replace(acc, ref, char(ref)))


def text_of(html: Column) -> Column:
    """Text of a fragment: scripts and styles out, breaks and block ends as new lines, tags out."""
    text = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>", "")
    text = F.regexp_replace(text, r"<br[^>]*>|</(?:p|div|li|dd|dt|tr|h[1-6])>", "\n")
    text = unescaped(F.regexp_replace(text, r"<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.translate(text, "　", " "), r"[ \t]+", " "))


def title(html: Column) -> Column:
    """Text of the first heading, empty without one."""
    return text_of(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1))


def fields(html: Column) -> Column:
    """Map of the definition lists' terms, then of the tables' two-cell rows; the first of a term stays."""
    pairs = lambda pattern: F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda m: F.struct(text_of(F.regexp_extract(m, pattern, 1)).alias("k"), text_of(F.regexp_extract(m, pattern, 2)).alias("v")))
    terms = pairs(r"(?s)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>")
    rows = pairs(r"(?s)<tr[^>]*>\s*<t[hd][^>]*>((?:(?!</t[hd]>).)*)</t[hd]>\s*<t[hd][^>]*>((?:(?!</t[hd]>).)*)</t[hd]>\s*</tr>")
    kept = F.concat(F.filter(terms, lambda p: p["k"] != ""), F.filter(rows, lambda p: (p["k"] != "") & (p["v"] != "") & (F.length(p["k"]) < 20)))
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(kept, lambda p: p["k"] == k), F.lit(0))["v"]))


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ord, href, label): each link of a page."""
    pattern = r'(?s)<a[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    found = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("ord", "m"))
    return found.select(key, "ord", F.regexp_extract("m", pattern, 1).alias("href"), text_of(F.regexp_extract("m", pattern, 2)).alias("label"))


def official_link(links: DataFrame, own: str, key: str = "page_id") -> DataFrame:
    """(key, href): the first link that leaves the site and is no social network; redirects unwrapped."""
    inner = F.regexp_extract("href", r"[?&](?:url|q|u)=(https?[^&]+)", 1)
    target = F.when(inner != "", F.try_url_decode(inner)).otherwise(F.col("href"))
    away = target.rlike("^https?://") & ~target.contains(own) & ~target.rlike(r"twitter\.com|facebook|line\.me|maps\.google")
    return links.withColumn("target", target).filter(away).groupBy(key).agg(F.min(F.struct("ord", "target")).alias("m")).select(key, F.col("m.target").alias("href"))


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """(url, category): titles of the pages at each parent path of a url, joined from the top."""
    parts = F.filter(F.split(F.regexp_replace("url", r"^https?://|[^/]*$", ""), "/"), lambda p: p != "")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path")))
    up = pages.select("url", F.explode(parents).alias("p")).select("url", "p.depth", "p.path")
    named = pages.select(F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"/(?:index\.html?)?$", "").alias("path"), F.col("title").alias("label"), F.col("url").alias("of"))
    met = up.join(named, "path").filter("url <> of and label <> ''").groupBy("url", "depth").agg(F.min("label").alias("label"))
    return met.groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "label"))), lambda x: x["label"]), " > ").alias("category"))


def toys(text: Column) -> Column:
    """Toys of a list in any of its separators, by their common names, each once, in order."""
    found = F.transform(F.filter(F.split(text, r"[、・,，/／\n]+"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    for other, name in TOY_ALIASES.items():
        found = _renamed(found, other, name)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("なし", "無", "その他", "-")))


def _renamed(items: Column, other: str, name: str) -> Column:
    return F.transform(items, lambda x: F.when(x == other, F.lit(name)).otherwise(x))


def opening_hours(text: Column) -> Column:
    """(open, close) as HH:MM from ``午前9時30分から午後5時``; null unless there are exactly two times."""
    found = F.regexp_extract_all(text, F.lit(r"午[前後]\s*[0-9]+時(?:\s*[0-9]+分)?"), F.lit(0))

    def clock(t: Column) -> Column:
        hour = F.regexp_extract(t, r"([0-9]+)時", 1).try_cast("int") + F.when(t.startswith("午後"), 12).otherwise(0)
        return F.format_string("%02d:%02d", hour, F.coalesce(F.regexp_extract(t, r"([0-9]+)分", 1).try_cast("int"), F.lit(0)))

    return F.when(F.size(found) == 2, F.struct(clock(F.get(found, F.lit(0))).alias("open"), clock(F.get(found, F.lit(1))).alias("close")))


def crawl(links: DataFrame, start: DataFrame, max_pages: int = 2000, skip: str | None = None, max_waves: int = 10_000, cut=None) -> DataFrame:
    """(url, wave): breadth-first from ``start`` (url) over links (src, dst); no new wave once
    ``max_pages`` are seen. Fails if links still lead on after ``max_waves``."""
    cut = cut or (lambda df: df.checkpoint())
    seen = cut(start.select("url").distinct().withColumn("wave", F.lit(0)))
    wanted = links if skip is None else links.filter(~F.col("dst").rlike(skip))
    for wave in range(1, max_waves + 1):
        front = seen.filter(F.col("wave") == wave - 1).select(F.col("url").alias("src"))
        new = front.join(wanted, "src").select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = cut(seen.union(new.withColumn("wave", F.lit(wave))))
        counts = seen.agg(F.count("*").alias("n"), F.count(F.when(F.col("wave") == wave, 1)).alias("fresh")).collect()[0]
        if not counts["fresh"] or counts["n"] >= max_pages:
            return seen
    raise RuntimeError(f"links still lead on after {max_waves} waves")

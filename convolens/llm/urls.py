"""URL filters whose block decisions reach aliases: pages tied by redirects and canonical links.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest
fitting rule decides. Pages without a rule follow their equivalence class: the connected component over
canonical-link and redirect edges. Such a page is blocked if a rule blocks a member of its class, unless
a rule explicitly allows another member; allowing goes first. DataFrame functions only.

A page is known by its address without scheme and fragment, so that an alias may be a page of the table
or only the target of a link; targets are judged by the rules as well. References are resolved against the page's
address or its first base tag, dot segments removed; other schemes than those with "://" lead nowhere. Rules are a list that becomes one
expression, so it must be of a size that a query plan holds.

Defined cases: a null url, or one without "://", has an empty host and path, no rule, and is allowed;
null html has no links. Rows that repeat get equal verdicts. Extra columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from convolens.llm.graph import components
from convolens.scale import keep

Rule = tuple[str, str, str]
# The rules of the query, as (verdict, host, beginning of the path).
RULES: list[Rule] = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

REFERENCE = r"^([^/?#]*)([^?#]*)"
TAGS = r"(?is)<(?:link|meta)\s[^>]*>"
CANONICAL = r"(?is)\srel\s*=\s*[\"']?(?:[^\"'>]*\s)?canonical[\s\"'/>]"
HREF = r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)\shttp-equiv\s*=\s*[\"']?refresh[\s\"'/>]"
BASE = r"(?is)<base\s[^>]*>"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!//)"
# The characters that may be written as entities in an address, the ampersand last.
ENTITIES = {
    '"': "(?i)&(quot|#34|#x22);", "'": "(?i)&(apos|#39|#x27);", "<": "(?i)&(lt|#60|#x3C);", ">": "(?i)&(gt|#62|#x3E);",
    "/": "(?i)&(sol|#47|#x2F);", ":": "(?i)&(colon|#58|#x3A);", "=": "(?i)&(equals|#61|#x3D);", "?": "(?i)&(quest|#63|#x3F);",
    "#": "(?i)&(num|#35|#x23);", ".": "(?i)&(period|#46|#x2E);", "&": "(?i)&(amp|#38|#x26);",
}
TARGET = r"(?is)\scontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'>\s]*)"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used; plans stay small so."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def after_scheme(url: Column) -> Column:
    """What follows the first "://", null where there is none."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host(rest: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest, REFERENCE, 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, REFERENCE, 2), F.lit(""))


def address(rest: Column) -> Column:
    """Host, path and query: what one page is known by."""
    return F.concat(host(rest), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def _fits(host_: Column, path_: Column, rule: Rule) -> Column:
    _, name, start = rule
    return ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(start)


def decided(host_: Column, path_: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The rule that decides and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest rule is asked first; of equally long ones the first by name.
    for r in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = _fits(host_, path_, r)
        rule, verdict = F.when(fits, r[1] + r[2]).otherwise(rule), F.when(fits, r[0]).otherwise(verdict)
    return rule, verdict


def href(tag: Column) -> Column:
    return F.concat(*(F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)))


def decoded(reference: Column) -> Column:
    def plain(text):
        out = text
        for character, entity in ENTITIES.items():
            out = F.regexp_replace(out, entity, character)
        return F.when(F.contains(text, F.lit("&")), out).otherwise(text)
    return once(F.trim(reference), plain)


def link_targets(html: Column) -> Column:
    """The references of canonical links and of redirects by meta refresh, as they stand in the page."""
    tags = F.regexp_extract_all(html, F.lit(TAGS), F.lit(0))
    found = F.transform(tags, lambda tag: decoded(
        F.when(tag.rlike(CANONICAL), href(tag)).when(tag.rlike(REFRESH), F.regexp_extract(tag, TARGET, 1))))
    return F.filter(found, lambda t: t.isNotNull() & (t != ""))


def without_dots(path_: Column) -> Column:
    """A path with its segments "." and ".." carried out; each step undoes all segments that a ".." follows directly."""
    def climbed(single):
        steps = F.sequence(F.lit(1), F.regexp_count(single, F.lit(r"/\.\.(?=/)")))
        undone = F.aggregate(steps, single, lambda p, _: F.when(
            F.contains(p, F.lit("/../")), F.regexp_replace(p, r"/(?!\.\.?/)[^/]*/\.\.(?=/)", "")).otherwise(p))
        return F.when(F.contains(single, F.lit("/../")), undone).otherwise(single)

    def tidied(raw):
        single = F.regexp_replace(F.regexp_replace(raw, r"/(\.\.?)$", "/$1/"), r"(?:/\.)+(?=/)", "")
        return F.when(F.contains(raw, F.lit("/.")), F.regexp_replace(once(single, climbed), r"^(?:/\.\.)+(?=/)", "")).otherwise(raw)

    return once(path_, tidied)


def resolved(rest: Column, reference: Column) -> Column:
    """The address that a reference in the page of this address leads to; null where it is none of a page."""
    def full(rest, reference):
        site = F.regexp_extract(rest, REFERENCE, 1)
        folder = F.regexp_replace(path(rest), "[^/]*$", "")
        return F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), after_scheme(reference)).when(
            reference.rlike(OTHER_SCHEME), F.lit(None)).when(
            reference.startswith("//"), F.substr(reference, F.lit(3))).when(
            reference.startswith("/"), F.concat(site, reference)).when(
            reference.startswith("?"), F.concat(site, path(rest), reference)).when(
            reference.startswith("#"), rest).otherwise(
            F.concat(site, F.when(folder == "", "/").otherwise(folder), reference))

    def tidied(address_):
        query = F.regexp_extract(address_, r"^[^?#]*(\?[^#]*)?", 1)
        return F.when(address_.isNotNull(), F.concat(host(address_), without_dots(path(address_)), query))

    return once(once(reference, lambda r: once(rest, lambda p: full(p, r))), tidied)


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between addresses: canonical links and redirects found in the pages."""
    rest = after_scheme(F.col("url"))
    base = decoded(href(F.regexp_extract("html", BASE, 0)))
    told = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & rest.isNotNull())
    return told.select(
        rest.alias("rest"), once(base, lambda b: F.when(b != "", resolved(rest, b)).otherwise(rest)).alias("base"),
        F.explode(link_targets(F.col("html"))).alias("target")).select(
        address(F.col("rest")).alias("a"),
        # A reference to a place in the page stays in the page.
        F.when(F.col("target").startswith("#"), address(F.col("rest"))).otherwise(
            resolved(F.coalesce("base", "rest"), F.col("target"))).alias("b")).where("b IS NOT NULL")


def judge(pages: DataFrame, rules: list[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. ``redirects``: further edges, columns from_url and to_url."""
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(
            address(after_scheme(F.col("from_url"))), address(after_scheme(F.col("to_url")))))
    members = components(edges)
    _, verdict = decided(host(F.col("node")), path(F.col("node")), rules)
    members = keep(members.withColumn("decided", verdict))
    classes = keep(members.groupBy("root").agg(
        F.max(F.col("decided") == "block").alias("blocked"), F.max(F.col("decided") == "allow").alias("allowed"))
        .where("blocked AND NOT allowed").select("root"))
    blocked = keep(members.where("decided IS NULL").join(classes, "root").select(
        F.col("node").alias("address"), F.lit("block").alias("passed_on")))
    rest = after_scheme(F.col("url"))
    rows = pages.select("page_id", host(rest).alias("host"), path(rest).alias("path"), address(rest).alias("address"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("verdict", verdict).join(blocked, "address", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "passed_on", F.lit("allow")).alias("verdict"))

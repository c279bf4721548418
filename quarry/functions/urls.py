"""URLs as column expressions: parts, resolution of references against a base (RFC 3986, section 5), canonical form and scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import col

#: A scheme proper; what stands before another colon belongs to the path.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: The same, or nothing.
BEFORE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
#: Paths with segments . and .., and few others.
DOTTED = r"(?:^|/)\.\.?(?:/|$)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once. Spark doesn't share what stands at several places of an expression within a lambda, so there it would be worked out at each place, and nested, a power as often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(c: Column | str, *names: str) -> Column:
    """These of the parts() as a struct."""
    p = parts(c)
    return F.struct(*(p[name].alias(name) for name in names))


def parts(c: Column | str) -> dict[str, Column]:
    """scheme, authority, path, query, fragment; null where a part isn't there, but for the path, which is '' then."""
    url = F.trim(col(c))
    return {
        "scheme": F.when(url.rlike(SCHEME), F.lower(F.regexp_extract(url, r"^([^:]+):", 1))),
        "authority": F.when(url.rlike(f"{BEFORE}//"), F.regexp_extract(url, f"{BEFORE}//([^/?#]*)", 1)),
        "path": F.regexp_extract(url, f"{BEFORE}(?://[^/?#]*)?([^?#]*)", 1),
        "query": F.when(url.rlike(r"^[^?#]*\?"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)),
        "fragment": F.when(url.contains("#"), F.regexp_extract(url, r"(?s)^[^#]*#(.*)$", 1)),
    }


def without_dots(path: Column | str) -> Column:
    """A path without its segments . and .., each of which takes the segment before it away; a path that ends in one ends in /."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        less = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(segment == ".", kept).when(segment == "..", less).otherwise(F.concat(kept, F.array(segment)))

    def short(p: Column, pieces: Column) -> Column:
        rooted = p.startswith("/")
        segments = F.when(rooted, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))).otherwise(pieces)
        kept = F.aggregate(segments, empty, step)
        ends = F.when(F.element_at(pieces, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(ends, "/"))

    return _once(col(path), lambda p: F.when(p.rlike(DOTTED), _once(F.split(p, "/"), lambda pieces: short(p, pieces))).otherwise(p))


def resolve(reference: Column | str, base: Column | str) -> Column:
    """The absolute URL that a reference stands for on a page with the URL base, with its fragment. Null if either is null."""
    names = ("scheme", "authority", "path", "query")
    absolute = _once(_parts(base, *names), lambda b: _once(_parts(reference, *names, "fragment"), lambda r: _resolved(r, b)))
    return F.when(col(reference).isNotNull() & col(base).isNotNull(), absolute)


def _resolved(r: Column, b: Column) -> Column:
    """resolve() of the parts of the reference and the base, which is null only where one of both is."""
    own = r["scheme"].isNotNull() | r["authority"].isNotNull()
    merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_extract(b["path"], r"(?s)^(.*/)?", 0), r["path"]))
    same_page = ~own & (r["path"] == "")
    path = F.when(same_page, b["path"]).otherwise(without_dots(F.when(own | r["path"].startswith("/"), r["path"]).otherwise(merged)))
    query = F.when(same_page & r["query"].isNull(), b["query"]).otherwise(r["query"])
    scheme, authority = F.coalesce(r["scheme"], b["scheme"]), F.when(own, r["authority"]).otherwise(b["authority"])
    return F.concat(
        F.coalesce(F.concat(scheme, F.lit(":")), F.lit("")), F.coalesce(F.concat(F.lit("//"), authority), F.lit("")), path,
        F.coalesce(F.concat(F.lit("?"), query), F.lit("")), F.coalesce(F.concat(F.lit("#"), r["fragment"]), F.lit("")),
    )


def canonical(url: Column | str, scopes: tuple[tuple[str, str], ...] = (), skip_path: str = "", skip_end: str = "") -> Column:
    """https, host in lower case, path without a slash at its end: one name for a page. Null for what isn't on the web, and out of scope.

    scopes: (host, path prefix) pairs, of which one must fit (none given: all do); skip_path and skip_end: patterns of paths, and of their ends, that are left out.
    """
    return _once(_parts(url, "scheme", "authority", "path"), lambda p: _once(F.lower(F.regexp_replace(p["authority"], r"^[^@]*@|:(80|443)$", "")), lambda host: _canonical(p, host, scopes, skip_path, skip_end)))


def _canonical(p: Column, host: Column, scopes: tuple[tuple[str, str], ...], skip_path: str, skip_end: str) -> Column:
    """canonical() of the parts of a URL, and its host in lower case."""
    path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
    fits = F.lit(not scopes)
    for domain, prefix in scopes:
        fits = fits | ((host == domain) & (path.startswith(prefix) | (path == prefix.rstrip("/"))))
    skipped = F.lit(False)
    for pattern in filter(None, (skip_path, f"(?i)(?:{skip_end})$" if skip_end else "")):
        skipped = skipped | path.rlike(pattern)
    short = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    whole = F.concat(F.lit("https://"), host, F.when(short == "", F.lit("/")).otherwise(short))
    return F.when(p["scheme"].isin("http", "https") & (host != "") & fits & ~skipped, whole)


def links(html: Column | str, base: Column | str, **scope) -> Column:
    """The canonical URLs that a page's links stand for, each once, in the order of their first appearance."""
    found = F.array_distinct(F.regexp_extract_all(col(html), F.lit(r"""(?i)\bhref\s*=\s*["']([^"'#][^"']*)"""), 1))
    targets = F.transform(F.transform(found, lambda h: resolve(h, base)), lambda u: canonical(u, **scope))
    return F.array_distinct(F.filter(targets, lambda u: u.isNotNull()))

"""Static or dynamic: what a page's HTML says about the need of a browser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Framework, marker and static-page patterns, matched without regard to case.
FRAMEWORKS = {
    "react": [r"react\.production\.min\.js", r"react-dom", r"__REACT_DEVTOOLS_GLOBAL_HOOK__", r"data-reactroot", r"_reactRootContainer"],
    "vue": [r"vue\.js", r"vue\.min\.js", r"data-v-[a-f0-9]+", r"__VUE__", r"Vue\.js"],
    "angular": [r"angular\.js", r"angular\.min\.js", r"ng-app", r"ng-controller", r"angular\.module"],
    "next.js": [r"_next/static", r"__NEXT_DATA__", r"next\.js"],
    "nuxt": [r"_nuxt", r"__NUXT__", r"nuxt\.js"],
    "svelte": [r"svelte-[a-z0-9]+", r"__svelte__"],
}
DYNAMIC_MARKERS = [
    r"""<div\s+id=["\']app["\']>\s*</div>""",
    r"""<div\s+id=["\']root["\']>\s*</div>""",
    r"window\.__INITIAL_STATE__",
    r"window\.__PRELOADED_STATE__",
    r"hydrate\s*\(",
    r"renderToString",
]
STATIC_MARKERS = [
    r"<!DOCTYPE\s+html[^>]*>\s*<html[^>]*>\s*<head",
    r"<article[^>]*>[\s\S]{500,}</article>",
    r"<main[^>]*>[\s\S]{500,}</main>",
]
QUICK_LITERALS = ['<div id="root"></div>', '<div id="app"></div>', "__NEXT_DATA__", "_nuxt"]


def markup_removed(html: Column, comments: bool) -> Column:
    """HTML without scripts, styles and tags, each tag a space. comments: take whole comments out before the tags."""
    bare = F.regexp_replace(html, r"(?i)<script[^>]*>[\s\S]*?</script>", "")
    bare = F.regexp_replace(bare, r"(?i)<style[^>]*>[\s\S]*?</style>", "")
    if comments:
        bare = F.regexp_replace(bare, r"<!--[\s\S]*?-->", "")
    return F.regexp_replace(bare, r"<[^>]+>", " ")


def visible_text(html: Column) -> Column:
    """The text that remains, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(markup_removed(html, comments=False), r"(?U)[\s\x1c-\x1f]+", " "))


def frameworks(html: Column) -> Column:
    """Names of the frameworks found, in catalogue order."""
    return F.array_compact(F.array(*(F.when(html.rlike("(?i)" + "|".join(p)), F.lit(name)) for name, p in FRAMEWORKS.items())))


def dynamic_markers(html: Column) -> Column:
    """The patterns found, each cut to 50 characters."""
    return F.array_compact(F.array(*(F.when(html.rlike("(?i)" + p), F.lit(p[:50])) for p in DYNAMIC_MARKERS)))


def looks_static(html: Column) -> Column:
    return html.rlike("(?i)" + "|".join(STATIC_MARKERS))


def needs_browser_quick(html: Column) -> Column:
    """Short pages, known shells, or little visible text."""
    shell = F.lit(False)
    for text in QUICK_LITERALS:
        shell = shell | F.contains(html, F.lit(text))
    return (F.char_length(html) < 1000) | shell | (F.char_length(visible_text(html)) < 200)


def analyze(html: Column, least_text: int = 500) -> Column:
    """A struct: frameworks, site_type, confidence, requires_browser, reasons. What is found in the page is looked for once and bound."""
    found = F.struct(frameworks(html).alias("names"), F.size(dynamic_markers(html)).alias("markers"), F.char_length(visible_text(html)).alias("length"), looks_static(html).alias("static"))
    return F.get(F.transform(F.array(found), lambda x: _verdict(x, least_text)), F.lit(0))


def _verdict(found: Column, least_text: int) -> Column:
    names, markers, length, static = (found[x] for x in ("names", "markers", "length", "static"))
    some, low = F.size(names) > 0, length < least_text
    score = F.lit(0.5) + F.when(some, 0.2).otherwise(0.0)
    score = score + F.when(markers > 0, 0.15).otherwise(0.0)
    score = F.when(low, score + 0.15).otherwise(score - 0.2)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - F.when(static, 0.3).otherwise(0.0)))
    chars = F.concat(F.lit(" text content ("), length.cast("string"), F.lit(" chars)"))
    # The sentences that give the reasons.
    reasons = F.array_compact(
        F.array(
            F.when(some, F.concat(F.lit("Detected frameworks: "), F.array_join(names, ", "))),
            F.when(markers > 0, F.concat(F.lit("Found "), markers.cast("string"), F.lit(" dynamic pattern(s)"))),
            F.concat(F.when(low, F.lit("Low")).otherwise(F.lit("Sufficient")), chars),
            F.when(static, F.lit("Content appears fully rendered")),
        )
    )
    kind = F.when(score > 0.6, "dynamic").when(score < 0.4, "static").otherwise("unknown")
    browser = F.when(score > 0.6, True).when(score < 0.4, False).otherwise(some)
    return F.struct(names.alias("frameworks"), kind.alias("site_type"), score.alias("confidence"), browser.alias("requires_browser"), reasons.alias("reasons"))

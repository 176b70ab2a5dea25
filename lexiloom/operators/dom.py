"""Checks of article HTML that need a document tree, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiloom.functions import html as fh
from lexiloom.functions import seo
from lexiloom.functions.numbers import units
from lexiloom.functions.text import strip
from lexiloom.operators.replies import parse_replies
from lexiloom.session import ship_code

_VOID = frozenset(fh.VOID_ELEMENTS)


class Tree(HTMLParser):
    """Elements in document order with attributes, parent and text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.stack: list[int] = []
        self.prose: list[str] = []
        self.hidden = 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and any(self.elements[i]["tag"] == "p" for i in self.stack):
            self.handle_endtag("p")  # a paragraph ends where the next begins
        self.elements.append({"tag": tag, "attrs": {k: v or "" for k, v in reversed(attrs)}, "parent": self.stack[-1] if self.stack else None, "text": []})
        if tag not in _VOID:
            self.stack.append(len(self.elements) - 1)
            self.hidden += tag in ("script", "style", "svg")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.elements[self.stack[depth]]["tag"] == tag:
                for i in self.stack[depth:]:
                    self.hidden -= self.elements[i]["tag"] in ("script", "style", "svg")
                del self.stack[depth:]
                return

    def handle_data(self, data: str) -> None:
        for i in self.stack:
            if self.elements[i]["tag"] == "p":
                self.elements[i]["text"].append(data)
        if not self.hidden:
            self.prose.append(data)

    def all(self, tag: str, attr: str | None = None) -> list[dict]:
        return [e for e in self.elements if e["tag"] == tag and (attr is None or attr in e["attrs"])]


def normal(text: str | None) -> str:
    return re.sub(r"\s+", " ", (text or "").lower().strip())


def keyphrase_count(text: str, phrase: str | None) -> int:
    key = normal(phrase)
    if not key:
        return 0
    pattern = re.sub(r"(?:\\?[\s-])+", lambda _: r"[\s-]+", re.escape(key))
    return len(re.findall(rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])", f" {normal(text)} "))


def tree_checks(html: str | None, phrase: str | None, own_host: str) -> dict[str, tuple[bool, str, str]]:
    """name: (pass, tier, detail)."""
    tree = Tree(html or "")
    out: dict[str, tuple[bool, str, str]] = {}
    key = normal(phrase)
    alts = [e["attrs"].get("alt", "") for e in tree.all("img")]
    out["image-alt"] = (bool(key) and any(normal(a).startswith(key) for a in alts), "hard", f"{len(alts)} images")
    longest = max((len("".join(e["text"]).split()) for e in tree.all("p")), default=0)
    out["paragraphs"] = (longest <= 120, "hard", f"longest {longest}")
    internal = external = bare = 0
    for e in tree.all("a", "href"):
        href = e["attrs"]["href"].strip()
        if href == "#":
            bare += 1
        elif re.match(r"(?i)https?://", href):
            try:
                host = re.sub(r"^www\.", "", urlsplit(href).hostname or "")
            except ValueError:
                host = ""
            internal, external = internal + (host == own_host), external + (host != own_host)
        elif href.startswith("/"):
            internal += 1
    out["links"] = (internal >= 5 and external >= 2 and bare == 0, "hard", f"{internal} internal, {external} external, {bare} bare")
    ids = Counter(e["attrs"]["id"] for e in tree.elements if "id" in e["attrs"])
    twice = [i for i, n in ids.items() if n > 1]
    out["dup-ids"] = (not twice, "hard", ", ".join(twice))
    plain = [e for e in tree.all("h3") if not e["attrs"].get("style", "").strip()]
    out["bare-h3"] = (not plain, "hard", f"{len(plain)} bare")
    out["no-script"] = (not tree.all("script"), "hard", f"{len(tree.all('script'))} scripts")
    cites = [i for i, e in enumerate(tree.elements) if e["tag"] == "sup" and e["attrs"].get("id", "").startswith("cite-")]
    refs = {e["attrs"]["id"] for e in tree.all("li", "id") if e["attrs"]["id"].startswith("ref-")}
    targets, seen = set(), set()
    for e in tree.all("a", "href"):
        above = e["parent"]
        while above is not None and above not in cites:
            above = tree.elements[above]["parent"]
        if above is not None and above not in seen and e["attrs"]["href"].startswith("#ref-"):
            seen.add(above)
            targets.add(e["attrs"]["href"][1:])
    out["citations"] = (len(cites) >= 4 and targets == refs, "hard", f"{len(cites)} citations, {len(refs)} references, {len(targets - refs)} and {len(refs - targets)} orphans")
    heads = {e["attrs"]["id"] for e in tree.all("h2", "id")}
    toc = sum(e["attrs"]["href"].startswith("#") and e["attrs"]["href"][1:] in heads for e in tree.all("a", "href"))
    out["toc"] = (toc >= 2, "soft", f"{toc} anchors")
    ads = [i for i, e in enumerate(tree.elements) if e["tag"] == "ins" and "adsbygoogle" in e["attrs"].get("class", "").split()]
    places = []
    for i in ads:
        parent = tree.elements[i]["parent"]
        share = (i if parent is None else parent) / max(1, len(tree.elements))
        places.append("early" if share < 1 / 3 else "middle" if share < 2 / 3 else "late")
    out["ad-slots"] = (len(ads) == 3 and len(set(places)) >= 2, "soft", ", ".join(places))
    words = re.sub(r"https?://\S+", " ", "".join(tree.prose)).split()
    out["first-100"] = (keyphrase_count(" ".join(words[:100]), phrase) >= 1, "hard", f"{len(words)} words")
    return out


#: The type of the column that ``with_checks`` adds.
_RESULTS = T.ArrayType(T.StructType([T.StructField("check", T.StringType()), T.StructField("tier", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("detail", T.StringType())]))


def with_checks(df: DataFrame, html: str = "html", phrase: str | None = None, own_host: str = "example.com") -> DataFrame:
    """df with ``tree``, an array of (check, tier, ok, detail): a document is parsed once, and its other columns pass through the batch.

    A null document is empty; a null phrase stands nowhere.
    """
    ship_code(df.sparkSession)
    at, key = df.columns.index(html), df.columns.index(phrase) if phrase else None
    kind = to_arrow_type(_RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = batch.column(key) if phrase else [None] * batch.num_rows
            made = [[{"check": name, "tier": tier, "ok": ok, "detail": detail} for name, (ok, tier, detail) in tree_checks(text.as_py(), words and words.as_py(), own_host).items()] for text, words in zip(batch.column(at), phrases, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, "tree"])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField("tree", _RESULTS)]))


def checks(df: DataFrame, key: str, html: str = "html", phrase: str | None = None, own_host: str = "example.com") -> DataFrame:
    """key, check, tier, ok, detail: the tree checks of every document."""
    columns = [key, html] + ([phrase] if phrase else [])
    return with_checks(df.select(*columns), html, phrase, own_host).select(key, F.explode("tree").alias("c")).select(key, "c.*")


def failing(tier: str) -> Column:
    """The sorted names of the tree's checks of a tier that do not hold."""
    return F.array_sort(F.transform(F.filter("tree", lambda c: (c["tier"] == tier) & ~c["ok"]), lambda c: c["check"]))


def own_failures(html: Column) -> Column:
    """The native hard checks that do not hold: title, meta, slug and h1 of the search fields (seo), tag balance and template leftovers."""
    k = F.col("seo.focusKeyword")
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(no(seo.title_ok(F.col("seo.seoTitle"), k)), "title"),
            F.when(no(seo.meta_ok(F.col("seo.metaDescription"), k)), "meta"),
            F.when(no(seo.slug_ok(F.col("seo.slug"), k)), "slug"),
            F.when(no(seo.heading_ok(F.col("seo.h1"), k)), "h1"),
            F.when(F.size(fh.tag_issues(html)) > 0, "tag-balance"),
            F.when(F.size(seo.template_leftovers(html, F.to_json("seo"))) > 0, "pipeline-artifacts"),
        )
    )


def gate(df: DataFrame, key: str, own_host: str) -> DataFrame:
    """key, publishable, failed, soft: whether all hard checks hold for (key, seo, html), which do not, and which soft ones do not.

    Native checks come first, then those of the tree, from one pass over the
    documents and without a shuffle.
    """
    rows = with_checks(df.select(key, "html", "seo", F.col("seo.focusKeyword").alias("phrase")), "html", "phrase", own_host)
    failed = F.concat(own_failures(F.col("html")), failing("hard"))
    return rows.select(key, failed.alias("failed"), failing("soft").alias("soft")).select(key, (F.size("failed") == 0).alias("publishable"), "failed", "soft")


def note_bundles(replies: DataFrame, key: str = "reply_id", own_host: str = "example.com") -> DataFrame:
    """key, publishable, failed, warnings, bundle of raw replies (key, raw): parsed, gated and, if all hard checks hold, bundled.

    A reply without a body of 200 characters, slug or key phrase fails before
    the checks.  The warnings are those of the parser and of the soft checks;
    the bundle is a struct of seo, html and publisher_notes, else null.
    """
    parsed = parse_replies(replies, key)
    empty = lambda f: F.coalesce(F.col(f"seo.{f}"), F.lit("")) == ""
    first = F.array_compact(F.array(F.when(units(strip(F.col("html"))) < 200, "EMPTY_BODY"), F.when(empty("slug"), "MISSING_SLUG"), F.when(empty("focusKeyword"), "MISSING_FOCUS_KEYWORD")))
    started = parsed.select(key, "seo", "html", "publisher_notes", "warnings", first.alias("first"), F.col("seo.focusKeyword").alias("phrase"))
    ready = F.size("first") == 0
    # a reply that fails before the checks is sent without its document, so that no tree is made of it
    sent = started.select("*", F.when(ready, F.col("html")).alias("checked"))
    made = with_checks(sent, "checked", "phrase", own_host)
    none = F.array().cast("array<string>")
    of_ready = lambda found: F.when(ready, found).otherwise(none)
    failed = F.concat("first", of_ready(F.concat(own_failures(F.col("html")), failing("hard"))))
    out = made.select(key, "seo", "html", "publisher_notes", failed.alias("failed"), F.concat("warnings", of_ready(failing("soft"))).alias("warnings"))
    bundle = F.when(F.size("failed") == 0, F.struct("seo", "html", "publisher_notes"))
    return out.select(key, (F.size("failed") == 0).alias("publishable"), "failed", "warnings", bundle.alias("bundle"))

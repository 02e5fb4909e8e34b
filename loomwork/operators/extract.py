"""Links and structured items out of pages."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import html as H
from loomwork.functions import urls as U
from loomwork.functions.transforms import strip

CONTEXT_LEN = 300
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
CONTEXT_TAGS = ("li", "p", "td", "div")
LINKS = pa.list_(pa.struct([("pos", pa.int64()), ("href", pa.string()), ("anchor", pa.string()), ("context", pa.string())]))


def _context(node) -> str:
    """Text around a link: its nearest li, else p, td or div."""
    for tag in CONTEXT_TAGS:
        found = H.select(node, f"ancestor::{tag}[1]")
        if found:
            return " ".join(found[0].texts()).strip()[:CONTEXT_LEN]
    return ""


def _page_links(page: str | None, base: str | None, selector: str) -> list[dict]:
    try:
        tree = H.parse(page or "")
    except ValueError:
        return []
    out = []
    for node in H.select(tree, selector):
        href = node.attrs.get("href", "").strip() if isinstance(node, H.Node) else ""
        if href:
            anchor = "".join(node.texts()).strip()
            out.append({"pos": len(out), "href": href if ABSOLUTE.match(href) else urljoin(base or "", href), "anchor": anchor, "context": _context(node)})
    return out


def page_links(page: str | None, base: str | None, selector: str = "//a") -> list[dict]:
    """pos, href, anchor and context of one page's links, with what stands for empty anchors and the sentence around each."""
    out = _page_links(page, base, selector)
    for link in out:
        link["anchor"] = link["anchor"] or link["href"].rsplit("/", 1)[-1].replace("-", " ")
        if link["context"] and link["anchor"]:
            sentence = next((x for x in link["context"].split(".") if link["anchor"].lower() in x.lower()), None)
            link["context"] = link["context"] if sentence is None else sentence.strip()
    return out


def extract_links(pages: DataFrame, selector: str | Column = "//a", key: str = "page_id", base: str = "url") -> DataFrame:
    """(key, page_url, pos, url, anchor, context) for each link with an address.

    selector is a path for all pages or a column with each page's own. Relative addresses are resolved against the
    column ``base``. Pages that can't be read, or without a selector, give no links."""
    schema = pa.schema([(key, pa.int64()), ("page_url", pa.string()), ("links", LINKS)])

    def run(batches):
        for b in batches:
            links = [_page_links(h, u, s) if s else [] for h, u, s in zip(*(b.column(c).to_pylist() for c in ("html", "page_url", "selector")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("page_url"), pa.array(links, LINKS)], schema=schema)

    rows = pages.select(F.col(key).cast("long").alias(key), F.col(base).alias("page_url"), "html", (selector if isinstance(selector, Column) else F.lit(selector)).alias("selector"))
    found = rows.mapInArrow(run, f"{key} long, page_url string, links array<struct<pos: long, href: string, anchor: string, context: string>>")
    flat = found.select(key, "page_url", F.explode("links").alias("l")).select(key, "page_url", "l.pos", F.col("l.href").alias("url"), "l.anchor", "l.context")
    flat = flat.withColumn("anchor", F.when(F.col("anchor") == "", U.last_segment(F.col("url"))).otherwise(F.col("anchor")))
    anchor, context = F.lower("anchor"), F.col("context")
    # Where the anchor was empty the sentence is looked for with its substitute.
    pick = F.try_element_at(F.filter(F.split(context, r"\."), lambda s: F.contains(F.lower(s), anchor)), F.lit(1))
    return flat.withColumn("context", F.when((context == "") | (F.col("anchor") == ""), context).otherwise(F.coalesce(strip(pick), context)))


def domain_links(pages: DataFrame, domains: DataFrame, key: str = "page_id") -> DataFrame:
    """extract_links() by pages(key, html, domain) and domains(domain, base_url, link_selector): each domain has its own
    selector and the address that its relative links are resolved against. Pages of unknown domains give none."""
    known = pages.select(key, "html", "domain").join(domains.select("domain", "base_url", "link_selector"), "domain")
    return extract_links(known, F.col("link_selector"), key, "base_url")


def _spec_type(fields: dict) -> str:
    return "struct<" + ", ".join(f"`{n}`: {'string' if f.get('type', 'list') == 'scalar' else 'array<string>'}" for n, f in fields.items()) + ">"


def _field(context, spec: dict):
    scalar = spec.get("type", "list") == "scalar"
    values = [H.as_text(v) for v in H.select(context, spec["selector"])] if spec.get("selector") else []
    if scalar:
        return values[0] if values else None
    return values


def checked_spec(spec: dict) -> dict:
    """The spec with its mode and fields; unknown modes and field types, and container mode without a selector, are errors."""
    mode, fields = spec.get("mode", "document"), spec.get("fields", {})
    if mode not in ("document", "container"):
        raise ValueError(f"extraction mode {mode!r} is neither document nor container")
    if mode == "container" and not spec.get("container"):
        raise ValueError("mode container needs the selector of its containers")
    for f in fields.values():
        if f.get("type", "list") not in ("scalar", "list"):
            raise ValueError(f"field type {f['type']!r} is neither scalar nor list")
    return spec | {"mode": mode, "fields": fields}


def page_items(page: str | None, spec: dict) -> list[dict]:
    """One page's items by a spec; a page that can't be read has none."""
    try:
        tree = H.parse(page or "")
    except ValueError:
        return []
    contexts = [tree] if spec.get("mode", "document") == "document" else H.select(tree, spec["container"])
    return [{n: _field(c, f) for n, f in spec.get("fields", {}).items()} for c in contexts]


def extract_items(pages: DataFrame, spec: dict, key: str = "page_id") -> DataFrame:
    """(key, pos, item) by an extraction spec; item is a struct made from the spec's fields.

    mode document gives one item for a page, mode container one for each container. Unknown modes and field
    types, and container mode without a selector, are errors when the plan is made."""
    spec = checked_spec(spec)
    fields = spec["fields"]
    item = pa.struct([(n, pa.string() if f.get("type", "list") == "scalar" else pa.list_(pa.string())) for n, f in fields.items()])
    schema = pa.schema([(key, pa.int64()), ("items", pa.list_(item))])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([page_items(h, spec) for h in b.column("html").to_pylist()], pa.list_(item))], schema=schema)

    rows = pages.select(F.col(key).cast("long").alias(key), "html").mapInArrow(run, f"{key} long, items array<{_spec_type(fields)}>")
    return rows.select(key, F.posexplode("items").alias("pos", "item"))

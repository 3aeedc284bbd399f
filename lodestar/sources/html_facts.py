"""What the extractors need of a page: one pass over its tags in Python, everything after that in column expressions."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FACTS = (
    "title string, h1 string, h2 string, h5 string, canonical string, metas array<struct<name:string,content:string>>,"
    " links array<struct<href:string,text:string,id:string,cls:string,label:string,around:string>>, boxes array<struct<tag:string,cls:string,text:string>>,"
    " cells array<array<string>>, ld array<string>, has_video boolean, video_src string, poster string, images array<struct<src:string,cls:string>>, text string"
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_AROUND = ("tr", "pre", "p")
_MEDIA = ("VideoObject", "MediaObject")


class _Reader(HTMLParser):
    """Keeps the text of open elements; an end tag closes what is open inside its element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.first: dict[str, str] = {}
        self.metas, self.links, self.boxes, self.rows, self.ld, self.images = [], [], [], [], [], []
        self.canonical = self.video_src = self.poster = None
        self.has_video, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            name = a.get("name") or a.get("property") or a.get("itemprop")
            if name and a.get("content"):
                self.metas.append((name.lower(), a["content"].strip()))
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = self.canonical or a.get("href")
        elif tag == "img":
            self.images.append((a.get("src"), a.get("class", "")))
        elif tag == "video":
            self.has_video = True
            self.video_src, self.poster = self.video_src or a.get("src"), self.poster or a.get("poster")
        elif tag == "source" and any(e["tag"] == "video" for e in self.open):
            self.video_src = self.video_src or a.get("src")
        if tag in _VOID:
            return
        if tag in ("p", "li", "tr", "td", "th") and any(e["tag"] == tag for e in self.open):
            inner = max(i for i, e in enumerate(self.open) if e["tag"] == tag)
            if not any(e["tag"] in ("table", "ul", "ol", "div") for e in self.open[inner + 1 :]):
                self.close(inner)
        self.open.append({"tag": tag, "a": a, "text": [], "cells": []})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        inner = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] == tag), None)
        if inner is not None:
            self.close(inner)

    def close(self, inner):
        while len(self.open) > inner:
            e = self.open.pop()
            text, tag, a = "".join(e["text"]), e["tag"], e["a"]
            if tag in ("title", "h1", "h2", "h5"):
                self.first.setdefault(tag, text.strip())
            elif tag == "a":
                around = next((o for o in reversed(self.open) if o["tag"] in _AROUND), None)
                self.links.append(({"href": a.get("href"), "text": text.strip(), "id": a.get("id", ""), "cls": a.get("class", ""), "label": a.get("aria-label", "")}, around))
            elif tag in ("div", "ul") and a.get("class"):
                self.boxes.append((tag, a["class"], text.strip()))
            elif tag in ("td", "th"):
                row = next((o for o in reversed(self.open) if o["tag"] == "tr"), None)
                if row is not None:
                    row["cells"].append(text.strip())
            elif tag == "tr":
                self.rows.append(e["cells"])
            elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
                self.ld.append(text)
            e["all"] = text
            if self.open:
                if tag not in ("script", "style"):
                    self.open[-1]["text"].append(text)

    def handle_data(self, data):
        if self.open:
            self.open[-1]["text"].append(data)
            if self.open[-1]["tag"] not in ("script", "style"):
                self.parts.append(data)
        else:
            self.parts.append(data)


def media_objects(scripts: list[str]) -> list[str]:
    """JSON of each video or media object in the scripts, below lists and @graph; scripts that do not parse are skipped."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            if "@graph" in x:
                walk(x["@graph"])
            kind = x.get("@type")
            if any(k in _MEDIA for k in (kind if isinstance(kind, list) else [kind])):
                out.append(json.dumps(x, ensure_ascii=False))

    for s in scripts:
        try:
            walk(json.loads(s, strict=False))
        except ValueError:
            continue
    return out


def read_page(html: str | None) -> dict:
    r = _Reader()
    r.feed(html or "")
    r.close(0)
    return {
        "title": r.first.get("title"), "h1": r.first.get("h1"), "h2": r.first.get("h2"), "h5": r.first.get("h5"), "canonical": r.canonical,
        "metas": [{"name": n, "content": c} for n, c in r.metas], "links": [{**link, "around": around["all"] if around is not None and "all" in around else None} for link, around in r.links],
        "boxes": [dict(zip(("tag", "cls", "text"), b)) for b in r.boxes], "cells": r.rows, "ld": media_objects(r.ld), "has_video": r.has_video, "video_src": r.video_src, "poster": r.poster,
        "images": [{"src": s, "cls": c} for s, c in r.images], "text": " ".join("".join(r.parts).split()),
    }


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with struct f of the facts."""
    rest = [c for c in pages.columns if c != html]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest] + [f.strip() for f in [FACTS]])

    kinds = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                facts = [read_page(h) for h in part.column(html).to_pylist()]
                made = [pa.array([f[k.name] for f in facts], type=k.type) for k in kinds]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], names=[*rest, *kinds.names])

    flat = pages.mapInArrow(run, schema)
    return flat.select(*rest, F.struct(*kinds.names).alias("f"))

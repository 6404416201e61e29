"""Metadata sidecars: destination plan, new text, and merging into existing XML."""

from __future__ import annotations

import re
import xml.parsers.expat
from urllib.parse import quote, unquote, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import color_text, variant_key, xml_escape

# Public metadata namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XMP = "http://ns.adobe.com/xap/1.0/"
XML_NS = "http://www.w3.org/XML/1998/namespace"
# Namespace and prefix of the decision property; a deployment may set its own.
DECISION_NS = "urn:curation:selection:1.0"
DECISION_PREFIX = "cur"
MAX_BYTES = 8 * 1024 * 1024


def sidecar_plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per destination, collisions).

    Rows with the same stem share a destination. That is allowed only for a
    RAW + JPEG set whose decision, stars, colour and variant id agree; the
    first row in path order then carries the sidecar. Aggregates have fixed-size
    state except the set of formats, which is one of five values.
    """
    dest = F.concat(variant_key("path"), F.lit(".xmp"))
    keyed = rows.withColumn("destination", dest)
    state = F.sha2(
        F.to_json(F.struct("decision", "rating", "color_label", "capture_variant_id"), {"ignoreNullFields": "false"}), 256
    )
    facts = keyed.groupBy("project_id", "destination").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("format") == "raw").alias("raws"),
        F.count_if(F.col("format") == "jpeg").alias("jpegs"),
        F.count("capture_variant_id").alias("named"),
        F.min(state).alias("lo"),
        F.max(state).alias("hi"),
        F.min(F.struct("path", "format")).alias("first"),
    )
    # Every later row is compared with the first one, so the first format may occur only once.
    raws, jpegs, others = F.col("raws"), F.col("jpegs"), F.col("n") - 1
    others_ok = ((F.col("first.format") == "raw") & (raws == 1) & (jpegs == others)) | (
        (F.col("first.format") == "jpeg") & (jpegs == 1) & (raws == others)
    )
    ok = (F.col("n") == 1) | (others_ok & (F.col("named") == F.col("n")) & (F.col("lo") == F.col("hi")))
    bad = facts.filter(~ok).select("project_id", "destination", F.col("n").alias("rows"))
    plan = facts.filter(ok).select("project_id", F.col("first.path").alias("path"), "destination").join(
        rows, ["project_id", "path"]
    )
    return plan, bad


def render_sidecars(rows: DataFrame, *, namespace: str = DECISION_NS, prefix: str = DECISION_PREFIX) -> DataFrame:
    """(project_id, destination, body) of new sidecars, as column expressions."""
    head = "<?xpacket begin='\ufeff' id='W5M0MpCehiHzreSzNTczkc9d'?>\n"
    description = F.format_string(
        f"<rdf:Description xmlns:rdf='{RDF}' rdf:about='' xmlns:xmp='{XMP}' xmlns:{prefix}='{namespace}' "
        f"xmp:Rating='%d' xmp:Label='%s' {prefix}:Decision='%s'/>",
        F.col("rating").cast("int"),
        xml_escape(color_text("color_label")),
        xml_escape("decision"),
    )
    body = F.concat(
        F.lit(head),
        F.lit(f"<x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='{RDF}'>"),
        description,
        F.lit("</rdf:RDF></x:xmpmeta>\n<?xpacket end='w'?>\n"),
    )
    return rows.select("project_id", "destination", body.alias("body"))


class _Spans:
    """Byte ranges of owned properties of one subject inside an XML document."""

    def __init__(self, data: bytes, source: str, namespace: str):
        self.data, self.source, self.ns = data, source, namespace
        self.roots: list[list] = []
        self.edits: list[tuple[int, int]] = []
        self.stack: list[dict] = []
        p = xml.parsers.expat.ParserCreate(namespace_separator="\u0001")
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.StartDoctypeDeclHandler = self.doctype
        self.p = p
        p.Parse(data, True)

    @staticmethod
    def split(name: str) -> tuple[str, str]:
        uri, _, local = name.rpartition("\u0001")
        return uri, local

    def owned(self, name: str) -> bool:
        uri, local = self.split(name)
        return (uri == XMP and local in ("Rating", "Label")) or (uri == self.ns and local == "Decision")

    def doctype(self, *_):
        raise ValueError("document types are not accepted")

    def tag_end(self, at: int) -> int:
        quote_, i = 0, at
        while True:
            c = self.data[i]
            if quote_:
                quote_ = 0 if c == quote_ else quote_
            elif c in b"'\"":
                quote_ = c
            elif c == 0x3E:
                return i + 1
            i += 1

    def start(self, name: str, attrs: dict):
        at = self.p.CurrentByteIndex
        parent = self.stack[-1] if self.stack else None
        base = urljoin(parent["base"] if parent else self.source, attrs.get(f"{XML_NS}\u0001base", ""))
        node = {"name": name, "at": at, "base": base, "attrs": attrs, "kids": [], "other": False, "open_end": self.tag_end(at)}
        uri, local = self.split(name)
        node["rdf"] = uri == RDF and local == "RDF"
        if parent is not None:
            owned = self.owned(name)
            if parent.get("subject"):
                if not owned:
                    parent["other"] = True
            node["owned_child"] = owned and bool(parent.get("subject"))
            if parent["rdf"] and uri == RDF and local == "Description":
                about = urljoin(base, attrs.get(f"{RDF}\u0001about", ""))
                parts = urlparse(about)
                node["subject"] = (
                    parts.scheme == "file" and not parts.query and not parts.fragment
                    and unquote(parts.path) == unquote(urlparse(self.source).path)
                )
        self.stack.append(node)

    def text(self, data: str):
        if self.stack and self.stack[-1].get("subject") and data.strip():
            self.stack[-1]["other"] = True

    def end(self, name: str):
        node = self.stack.pop()
        at = self.p.CurrentByteIndex
        empty = self.data[node["open_end"] - 2 : node["open_end"]] == b"/>"
        stop = node["open_end"] if empty else self.tag_end(at)
        if node["rdf"]:
            self.roots.append([node["at"], node["open_end"], None if empty else at, stop, node["base"]])
        if node.get("owned_child") and self.stack:
            self.stack[-1]["kids"].append((node["at"], stop))
        if node.get("subject"):
            mine = [a for a in node["attrs"] if self.owned(a)]
            foreign = [a for a in node["attrs"] if not self.owned(a) and a != f"{RDF}\u0001about"]
            if (mine or node["kids"]) and not foreign and not node["other"]:
                self.edits.append((node["at"], stop))
            else:
                self.edits.extend(node["kids"])
                self.edits.extend(self.attribute_spans(node, mine))

    def attribute_spans(self, node: dict, mine: list[str]) -> list[tuple[int, int]]:
        """Locate owned attributes in the raw start tag by their local names and values' quotes."""
        raw = self.data[node["at"] : node["open_end"]]
        spans = []
        for m in re.finditer(rb"\s([^\s=/>'\"]+)\s*=\s*('[^']*'|\"[^\"]*\")", raw):
            label = m.group(1).decode("utf-8", "replace")
            local = label.rpartition(":")[2]
            if ":" in label and any(self.split(a)[1] == local for a in mine):
                if self.prefix_owned(label.partition(":")[0], local, node):
                    spans.append((node["at"] + m.start(1), node["at"] + m.end()))
        return spans

    def prefix_owned(self, prefix: str, local: str, node: dict) -> bool:
        want = XMP if local in ("Rating", "Label") else self.ns
        decl = re.compile(rb"xmlns:" + re.escape(prefix.encode()) + rb"\s*=\s*['\"]([^'\"]*)['\"]")
        for scope in [*reversed([n for n in self.stack] + [node])]:
            hit = decl.search(self.data[scope["at"] : scope["open_end"]])
            if hit:
                return hit.group(1).decode() == want
        return False


def merge_text(original: str, *, path: str, rating: int, label: str, decision: str, namespace: str = DECISION_NS, prefix: str = DECISION_PREFIX) -> str:
    """Existing sidecar with the owned properties of ``path`` replaced; every other byte is kept."""
    data = original.encode("utf-8")
    if len(data) > MAX_BYTES:
        raise ValueError("sidecar exceeds the size limit")
    source = "file://" + quote(path)
    found = _Spans(data, source, namespace)
    if len(found.roots) != 1:
        raise ValueError("a sidecar must contain exactly one RDF root")
    at, open_end, close_at, stop, base = found.roots[0]
    about = ""
    if base != source:
        name = source.rpartition("/")[2]
        here, there = base.rpartition("/")[0].split("/"), source.rpartition("/")[0].split("/")
        if here[: len(there)] != there:
            raise ValueError("base cannot address this row without exposing folders")
        about = "../" * (len(here) - len(there)) + name

    def esc(v: str) -> str:
        for a, b in (("&", "&amp;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            v = v.replace(a, b)
        return v

    body = (
        f"<rdf:Description xmlns:rdf='{RDF}' rdf:about='{esc(about)}' xmlns:xmp='{XMP}' xmlns:{prefix}='{namespace}' "
        f"xmp:Rating='{rating}' xmp:Label='{esc(label)}' {prefix}:Decision='{esc(decision)}'/>"
    ).encode()
    edits = [(a, b, b"") for a, b in found.edits]
    if close_at is None:
        name = data[at + 1 : open_end].split()[0].rstrip(b"/>")
        edits.append((open_end - 2, open_end, b">" + body + b"</" + name + b">"))
    else:
        edits.append((close_at, close_at, body))
    out, cursor = bytearray(), 0
    for a, b, new in sorted(edits):
        if a < cursor:
            raise ValueError("overlapping properties")
        out += data[cursor:a] + new
        cursor = b
    out += data[cursor:]
    xml.parsers.expat.ParserCreate().Parse(bytes(out), True)
    return out.decode("utf-8")


def merge_sidecars(rows: DataFrame, *, namespace: str = DECISION_NS, prefix: str = DECISION_PREFIX) -> tuple[DataFrame, DataFrame]:
    """(merged bodies, rejects) for rows joined to their existing sidecar text.

    ``rows``: destination, path (absolute), existing (text), rating, color_label,
    decision. Sidecars are independent and at most 8 MiB each.
    """

    def work(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    out.append((r.destination, merge_text(r.existing, path=r.path, rating=int(r.rating), label=r.label, decision=r.decision, namespace=namespace, prefix=prefix), None))
                except Exception as error:  # noqa: BLE001 - any malformed sidecar becomes a reject row
                    out.append((r.destination, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["destination", "body", "error"])

    done = rows.select(
        "destination", "path", "existing", "rating", color_text("color_label").alias("label"), "decision"
    ).mapInPandas(work, "destination string, body string, error string")
    return done.filter("error IS NULL").select("destination", "body"), done.filter("error IS NOT NULL").select(
        "destination", "error"
    )

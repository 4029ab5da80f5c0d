"""Statute documents (gzipped CLML) as tables of instruments, provisions and citations.

``scan`` reads whole files as rows and parses each in the task that reads it; a document that cannot be used is a row with
status ``failed`` and its error, never an exception. Identity comes from the document's IdURI, not from its path.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import date
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import uris as U
from citeloom.functions.grammar import Query, title_words

LEG, UKM = "{http://www.legislation.gov.uk/namespaces/legislation}", "{http://www.legislation.gov.uk/namespaces/metadata}"
DC, DCT = "{http://purl.org/dc/elements/1.1/}", "{http://purl.org/dc/terms/}"


def _tags(names: str) -> frozenset:
    return frozenset(LEG + n for n in names.split())


# The roles of elements.
UNITS = _tags("P1 P2 P3 P4 P5 P6 P7 P Pblock PsubBlock Part Chapter Schedule Group Appendix")
SKIPPED = _tags("Contents Resources Commentaries") | {UKM + "Metadata"}
APPARATUS = _tags("Commentaries Commentary CommentaryRef Footnotes Footnote FootnoteRef MarginNotes MarginNoteRef Resources")
LABELS = _tags("Pnumber Number Title TitleBlock")
CONTEXTS = _tags("Text Title Para Entry")
GROUPS = ("pt", "ch", "grp", "app")
# End of the fixed values.

INSTRUMENT = (
    "coordinate string, instrument_id string, domain string, jurisdiction string, authority_type string, document_type string, title string,"
    " title_as_published string, year int, number int, alternative_numbers array<struct<category:string,value:string>>, enactment_date date,"
    " made_date date, repealed boolean, structure string, provision_count int, alternative_versions int, duplicated_provisions array<string>,"
    " groups map<string,array<string>>, long_title string, other_titles array<string>, text_version string, version_date date,"
    " normative_tier int, licence string, source_url string, source_sha256 string"
)
PROVISION = (
    "coordinate string, instrument_id string, parent string, `order` int, number_label string, title string, crossheading string,"
    " repealed boolean, prospective boolean, text string, text_after string, source_url string"
)
CITATION = (
    "source_coordinate string, kind string, text string, context string, span array<int>, target_uri string, target_coordinate string,"
    " target_class string, citation_id string, citation_ref string, in_commentary boolean, in_amendment boolean"
)


class BadDocument(ValueError):
    pass


class _Scope(NamedTuple):
    """What an element has from those around it."""

    inside: str
    status: str | None = None
    groups: tuple[str, ...] = ()
    heading: str | None = None
    block: ET.Element | None = None
    cross: str | None = None
    only_citations: bool = False
    commentary: bool = False
    amendment: bool = False


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _text(e: ET.Element | None) -> str | None:
    return None if e is None else _squeeze("".join(e.itertext())) or None


def _value(of: ET.Element | None, name: str, attribute: str = "Value") -> str | None:
    found = None if of is None else of.find(UKM + name)
    return None if found is None else found.get(attribute)


def _day(text: str | None) -> str | None:
    try:
        return date.fromisoformat((text or "")[:10]).isoformat()
    except ValueError:
        return None


class _Document:
    def __init__(self, root: ET.Element, coordinate: str):
        self.root, self.own = root, coordinate
        self.prefix = coordinate.removeprefix("uk/") + "/"
        self.provisions: dict[str, dict] = {}
        self.keys: dict[str, str] = {}
        self.citations: list[dict] = []
        self.warnings: list[str] = []
        self.repeated: dict[str, None] = {}
        self.groups: dict[str, list[str]] = {}
        self.members: dict[str, set[str]] = {}
        self.versions = 0

    def coordinate(self, e: ET.Element) -> str | None:
        """The provision that an element is, if it is one of this instrument."""
        if e.tag not in UNITS:
            return None
        path = U.address_path(e.get("IdURI"))
        if path is not None:
            tokens = path[len(self.prefix) :].split("/") if path.startswith(self.prefix) else []
        else:
            tokens = (e.get("id") or "").split("-") if e.get("id") else []
        tail = U.tail_of(tokens) if tokens and "crossheading" not in tokens else None
        made = f"{self.own}/{'/'.join(tail)}" if tail else None
        return made if made and U.valid(made) else None

    def pieces(self, e: ET.Element, own: bool) -> Iterator[str | None]:
        """An element's text in order; None stands for a provision within."""
        yield e.text or ""
        for k in e:
            quoted = k.tag == LEG + "BlockAmendment"
            if own and not quoted and self.coordinate(k):
                yield None
            elif k.tag not in APPARATUS and not (own and k.tag in LABELS):
                yield from self.pieces(k, own and not quoted)
            yield k.tail or ""

    def texts(self, e: ET.Element) -> tuple[str, str]:
        """Words before the first inner provision, and after it."""
        parts = list(self.pieces(e, True))
        cut = parts.index(None) if None in parts else len(parts)
        join = lambda xs: _squeeze("".join(x for x in xs if x))
        return join(parts[:cut]), join(parts[cut:])

    def walk(self) -> None:
        todo = [(self.root, _Scope(self.own))]
        while todo:
            e, s = todo.pop()
            if not s.only_citations and e.tag in SKIPPED:
                continue
            if not s.only_citations and e.tag == LEG + "Versions":
                self.versions += sum(1 for _ in e.iter(LEG + "Version"))
                continue
            if e.tag in CONTEXTS:
                s = s._replace(block=e)
            if not s.only_citations:
                s = self.enter(e, s)
            if e.tag in (LEG + "Citation", LEG + "CitationSubRef"):
                self.cite(e, s)
            inner = s if e.tag == LEG + "P1group" else s._replace(heading=None)
            todo += [(k, inner) for k in reversed(e)]
        notes = self.root.find(f".//{LEG}Commentaries")
        if notes is not None:
            self.collect(notes, _Scope(self.own, only_citations=True, commentary=True))

    def collect(self, e: ET.Element, s: _Scope) -> None:
        todo = [(e, s)]
        while todo:
            e, s = todo.pop()
            s = s._replace(block=e) if e.tag in CONTEXTS else s
            if e.tag in (LEG + "Citation", LEG + "CitationSubRef"):
                self.cite(e, s)
            todo += [(k, s) for k in reversed(e)]

    def enter(self, e: ET.Element, s: _Scope) -> _Scope:
        if e.tag == LEG + "BlockAmendment":
            return s._replace(only_citations=True, amendment=True)
        s = s._replace(status=e.get("Status", s.status))
        title = _text(e.find(LEG + "Title"))
        if e.tag == LEG + "P1group":
            s = s._replace(heading=title)
        elif e.tag == LEG + "Pblock":
            s = s._replace(cross=title)
        elif e.tag == LEG + "PsubBlock":
            s = s._replace(cross=" - ".join(x for x in (s.cross, title) if x) or None)
        c = self.coordinate(e)
        if c is None:
            return s
        if c in self.provisions:
            self.warnings.append(f"duplicate provision {c}; first occurrence kept")
            self.repeated[c] = None
            return s
        self.emit(e, c, s)
        tail = c[len(self.own) + 1 :]
        return s._replace(inside=c, groups=(*s.groups, tail) if tail.rsplit("/", 1)[-1].startswith(GROUPS) else s.groups)

    def emit(self, e: ET.Element, c: str, s: _Scope) -> None:
        if self.keys.setdefault(c.lower(), c) != c:
            self.warnings.append(f"case variant {c} of {self.keys[c.lower()]}")
        tail = c[len(self.own) + 1 :].split("/")
        above = next((x for i in range(len(tail) - 1, 0, -1) if (x := "/".join([self.own, *tail[:i]])) in self.provisions), self.own)
        whole, parent = "/".join(tail), "/".join(tail[:-1])
        for g in s.groups:
            if whole != g and not whole.startswith(g + "/"):
                if parent not in self.members.setdefault(g, set()):
                    self.groups.setdefault(g, []).append(whole)
                self.members[g].add(whole)
        first = e.tag == LEG + "P1"
        title = (s.heading if first else None) or _text(e.find(LEG + "Title")) or _text(e.find(f"{LEG}TitleBlock/{LEG}Title"))
        before, after = self.texts(e)
        self.provisions[c] = {
            "coordinate": c, "instrument_id": self.own.replace("/", "_"), "parent": above, "order": len(self.provisions),
            "number_label": _text(e.find(LEG + "Pnumber")) or _text(e.find(LEG + "Number")), "title": title, "crossheading": s.cross if first else None,
            "repealed": s.status == "Repealed", "prospective": s.status == "Prospective", "text": before, "text_after": after,
            "source_url": U.SITE + self.prefix + U.path_of(tail),
        }

    def cite(self, e: ET.Element, s: _Scope) -> None:
        text = _squeeze("".join(e.itertext()))
        if not (e.get("URI") and text):
            return
        context, at = text, 0
        if s.block is not None:
            whole = _squeeze("".join(s.block.itertext()))
            guess = len(re.sub(r"\s+", " ", "".join(_before(s.block, e))).lstrip())
            place = guess if whole[guess : guess + len(text)] == text else whole.find(text)
            if place >= 0:
                context, at = whole, place
        self.citations.append(
            {
                "source_coordinate": s.inside, "kind": "citation" if e.tag == LEG + "Citation" else "subref", "text": text, "context": context,
                "span": [at, at + len(text)], "target_uri": e.get("URI"), "target_coordinate": U.coordinate_of(e.get("URI")),
                "target_class": e.get("Class"), "citation_id": e.get("id"), "citation_ref": e.get("CitationRef"), "in_commentary": s.commentary,
                "in_amendment": s.amendment,
            }
        )


def _before(block: ET.Element, target: ET.Element) -> Iterator[str]:
    """Text of block that comes before target."""
    todo: list = [block]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif x is target:
            return
        else:
            for k in reversed(x):
                todo += [k.tail or "", k]
            todo.append(x.text or "")


def parse(data: bytes, sha256: str | None = None) -> dict:
    """instrument, provisions, citations and warnings of a document; BadDocument if it is none we know."""
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise BadDocument("document type declarations are refused")
    try:
        root = ET.fromstring(data)
    except ET.ParseError as e:
        raise BadDocument(f"XML parse error: {e}") from e
    path = U.address_path(root.get("IdURI"))
    if path is None:
        raise BadDocument("document has no IdURI")
    own = f"uk/{path}"
    if not U.valid(own):
        raise BadDocument(f"IdURI {path!r} is not a UK instrument coordinate")
    seg = own.split("/")
    if len(seg) != (4 if seg[2].isdigit() else 5):
        raise BadDocument(f"IdURI {path!r} names a provision, not an instrument")
    meta = root.find(UKM + "Metadata")
    if meta is None:
        raise BadDocument("document has no metadata")
    kind = next((k for k in (meta.find(UKM + "PrimaryMetadata"), meta.find(UKM + "SecondaryMetadata")) if k is not None), None)
    if kind is None:
        raise BadDocument("document has neither primary nor secondary metadata")
    published = _text(meta.find(DC + "title"))
    if not published:
        raise BadDocument("document has no title")
    year, number = _value(kind, "Year") or "", _value(kind, "Number") or ""
    if not (year.isdigit() and number.isdigit()):
        raise BadDocument("document has no numeric Year/Number")
    title, repealed = U.clean_title(published)
    doc = _Document(root, own)
    doc.walk()
    if seg[2].isdigit() and seg[2] != year:
        doc.warnings.append(f"metadata year {year} differs from IdURI year")
    classes = kind.find(UKM + "DocumentClassification")
    primary = _value(classes, "DocumentCategory") == "primary"
    instrument = {
        "coordinate": own, "instrument_id": own.replace("/", "_"), "domain": "uk_legislation", "jurisdiction": "UK",
        "authority_type": "PRIMARY_ACT" if primary else "SECONDARY_INSTRUMENT", "document_type": _value(classes, "DocumentMainType") or "unknown",
        "title": title, "title_as_published": published, "year": int(year), "number": int(number),
        "alternative_numbers": [{"category": a.get("Category", "unknown"), "value": a.get("Value")} for a in kind.findall(UKM + "AlternativeNumber") if a.get("Value")],
        "enactment_date": _day(_value(kind, "EnactmentDate", "Date")), "made_date": _day(_value(kind, "Made", "Date")), "repealed": repealed,
        "structure": "full" if doc.provisions else "metadata_only", "provision_count": len(doc.provisions), "alternative_versions": doc.versions,
        "duplicated_provisions": list(doc.repeated), "groups": dict(sorted(doc.groups.items())), "long_title": _text(root.find(f".//{LEG}LongTitle")),
        "other_titles": other_titles(meta, own, title), "text_version": "current" if _value(classes, "DocumentStatus") == "revised" else "as_enacted",
        "version_date": _day(_text(meta.find(DCT + "valid"))), "normative_tier": 1 if primary else 2, "licence": "OGL-3.0",
        "source_url": U.SITE + path, "source_sha256": sha256 or hashlib.sha256(data).hexdigest(),
    }
    return {"instrument": instrument, "provisions": list(doc.provisions.values()), "citations": doc.citations, "warnings": doc.warnings}


def other_titles(meta: ET.Element, own: str, title: str) -> list[str]:
    """Titles that effects on this instrument give it besides its own."""
    words = lambda t: title_words(Query(t).folded)
    found = set()
    for e in (x for tag in ("UnappliedEffect", "Effect") for x in meta.iter(UKM + tag)):
        if U.coordinate_of(e.get("AffectedURI")) == own:
            found |= {U.clean_title(t)[0] for t in map(_text, e.findall(UKM + "AffectedTitle")) if t}
    return sorted(t for t in found if words(t) != words(title))


def parsed(files: DataFrame) -> DataFrame:
    """(source, source_sha256, status, error, instrument, provisions, citations, warnings) of rows (path, content), gzipped or plain."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sha = None
                try:
                    raw = content.as_py()
                    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                    sha = hashlib.sha256(raw).hexdigest()
                    got = parse(raw, sha)
                    row = (path, sha, "ok", None, *(json.dumps(got[k], ensure_ascii=False) for k in ("instrument", "provisions", "citations")), got["warnings"])
                except Exception as e:  # told in the row
                    row = (path, sha, "failed", f"{type(e).__name__}: {e}", None, None, None, [])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.string()] * 7 + [pa.list_(pa.string())]
            names = ["source", "source_sha256", "status", "error", "instrument", "provisions", "citations", "warnings"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "source string, source_sha256 string, status string, error string, instrument string, provisions string, citations string, warnings array<string>"
    raw = files.select("path", "content").mapInArrow(run, schema)
    return raw.withColumns(
        {
            "instrument": F.from_json("instrument", INSTRUMENT), "provisions": F.from_json("provisions", f"array<struct<{_fields(PROVISION)}>>"),
            "citations": F.from_json("citations", f"array<struct<{_fields(CITATION)}>>"),
        }
    )


def _fields(ddl: str) -> str:
    return ", ".join(": ".join(x.strip().split(" ", 1)) for x in re.split(r",(?![^<]*>)", ddl))


def scan(spark: SparkSession, path: str, glob: str = "*.xml.gz") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return parsed(files)


def instruments(docs: DataFrame) -> DataFrame:
    """One row an instrument; where files hold the same one, the first by source stays."""
    ok = docs.where("status = 'ok'").groupBy("instrument.instrument_id").agg(F.min_by("instrument", "source").alias("i"))
    return ok.select("i.*")


def provisions(docs: DataFrame) -> DataFrame:
    return docs.where("status = 'ok'").select(F.explode("provisions").alias("p")).select("p.*")


def citations(docs: DataFrame) -> DataFrame:
    """The harvest, with each citation's number in its document."""
    rows = docs.where("status = 'ok'").select(F.col("instrument.instrument_id").alias("instrument_id"), F.posexplode("citations").alias("seq", "c"))
    return rows.select("instrument_id", "seq", "c.*")


def unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, content) that known (source, source_sha256) does not hold as they are now; only these need parsing."""
    plain = F.sha2(F.col("content"), 256)
    return files.withColumn("sha256", plain).join(known.select(F.col("source").alias("path"), F.col("file_sha256").alias("sha256")), ["path", "sha256"], "left_anti")


def peek(files: DataFrame) -> DataFrame:
    """(path, instrument_id) from the first 4 KB of plain files."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    found = F.regexp_extract(head, r'IdURI="https?://www\.legislation\.gov\.uk/id/([^"]+)"', 1)
    return files.select("path", F.when(found != "", F.concat(F.lit("uk_"), F.translate(found, "/", "_"))).alias("instrument_id"))


def report(docs: DataFrame) -> DataFrame:
    """One row: documents by status, structured ones, provisions, citations, instruments that several documents claim."""
    ids = docs.where("status = 'ok'").groupBy("instrument.instrument_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("collisions"))
    counts = docs.agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("instrument.structure") == "full").alias("structured"),
        F.coalesce(F.sum(F.size("provisions")), F.lit(0)).alias("provisions"), F.coalesce(F.sum(F.size("citations")), F.lit(0)).alias("citations"),
    )
    return counts.crossJoin(ids)  # one row each

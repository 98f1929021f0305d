"""Tables and reports out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.search import Result, value_text


def write_facts(facts: DataFrame, path: str) -> None:
    """By source, sorted by unit and value within files, so that row groups carry
    narrow bounds for the numeric track (K10)."""
    facts.repartition("source", "unit_canon").sortWithinPartitions("source", "unit_canon", "value_low").write.mode("overwrite").partitionBy("source").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").partitionBy("type").parquet(path)


def write_postings(index: DataFrame, table: str, buckets: int = 64) -> None:
    """Bucketed by lemma, so a look-up reads one bucket."""
    index.write.mode("overwrite").bucketBy(buckets, "lemma").sortBy("lemma", "doc_id").saveAsTable(table)


def append_events(events: DataFrame, path: str) -> None:
    """K14."""
    events.write.mode("append").json(path)


def export_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines, in order of time over all files."""
    events.repartitionByRange("ts").sortWithinPartitions("ts").write.mode("overwrite").json(path)


def write_embeddings(vectors: DataFrame, path: str, dimension: int) -> None:
    """(vec_id, embedding, ...): vectors of one length, without nulls; another one is an error of
    the task that meets it."""
    fits = F.coalesce((F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    checked = F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"not a vector of {dimension} numbers: "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    vectors.withColumn("embedding", checked).sortWithinPartitions("vec_id").write.mode("overwrite").parquet(path)


def with_places(documents: DataFrame, first_places: DataFrame) -> DataFrame:
    """A document's place, where none is known, from its first facility."""
    found = first_places.groupBy("doc_id").agg(F.min_by("geo", "sent_no").alias("_geo"))
    return documents.join(found, "doc_id", "left").withColumn("geo", F.coalesce("geo", "_geo")).drop("_geo")


def replace_version(df: DataFrame, root: str, version: str) -> str:
    """A new version of a table in a folder of its own; readers of the old one go on."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest(spark: SparkSession, root: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("version="))
    return spark.read.parquet(f"{root}/{names[-1]}")


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, or null: what a constraint would refuse."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null)


def markdown(result: Result) -> str:
    """K16."""
    out = [f"# {result.query}", "", f"Intent: {result.intent}. Hidden documents: {result.hidden_count}.", "", "| entity | metric | value | document |", "|---|---|---|---|"]
    out += [f"| {f.get('canon') or ''} | {f.get('metric') or ''} | {value_text(f)} | {f.get('doc_id')} |" for f in result.facts]
    if result.experts:
        out += ["", "## Experts"] + [f"- {e['author']} ({e['docs']})" for e in result.experts]
    return "\n".join(out) + "\n"


def json_ld(result: Result) -> str:
    """A graph of schema.org nodes, each id once."""
    nodes: dict[str, dict] = {}
    for f in result.facts:
        doc, entity = f"doc/{f.get('doc_id')}", f"entity/{f.get('canon')}"
        nodes.setdefault(doc, {"@id": doc, "@type": "ScholarlyArticle"})
        nodes.setdefault(entity, {"@id": entity, "@type": "Thing", "name": f.get("canon")})
        own = f"fact/{f.get('pkey')}"
        nodes.setdefault(own, {"@id": own, "@type": "PropertyValue", "name": f.get("metric"), "minValue": f.get("value_low"), "maxValue": f.get("value_high"), "unitText": f.get("unit_canon"), "isPartOf": {"@id": doc}, "about": {"@id": entity}})
    for e in result.experts:
        nodes.setdefault(f"person/{e['author']}", {"@id": f"person/{e['author']}", "@type": "Person", "name": str(e["author"])})
    return json.dumps({"@context": "https://schema.org", "@graph": list(nodes.values())}, ensure_ascii=False, default=str)


def _fonts(text: str) -> dict[str, tuple[int, int]]:
    """Letter -> (font, code): Latin ones in font 0 under their own codes, others 200 to a font."""
    others = sorted({c for c in text if not " " <= c <= "~"})
    return {c: (0, ord(c)) for c in map(chr, range(32, 127))} | {c: (1 + i // 200, 32 + i % 200) for i, c in enumerate(others)}


def _font(letters: list[tuple[int, str]], cmap: int) -> tuple[bytes, bytes]:
    """A font whose codes stand for named letters, and the table that tells readers which."""
    names = b" ".join(b"%d /uni%04X" % (code, ord(c)) if ord(c) < 65536 else b"%d /u%05X" % (code, ord(c)) for code, c in letters)
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Type /Encoding /Differences [" + names + b"] >> /ToUnicode %d 0 R >>" % cmap
    rows = b"\n".join(b"<%02X> <" % code + c.encode("utf-16-be").hex().upper().encode() + b">" for code, c in letters)
    table = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /own def /CMapType 2 def 1 begincodespacerange <00> <FF> endcodespacerange %d beginbfchar\n" % len(letters) + rows + b"\nendbfchar endcmap end end"
    return font, b"<< /Length %d >>\nstream\n" % len(table) + table + b"\nendstream"


def pdf(result: Result, per_page: int = 48) -> bytes:
    """A plain PDF of the report. No letter is lost: those outside ASCII stand in fonts that name
    them, with a table from which readers search and copy the text."""
    lines = markdown(result).split("\n")
    place = _fonts("".join(lines))
    fonts = 1 + max(f for f, _ in place.values())
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    named = [3]
    for f in range(1, fonts):
        named.append(len(objects) + 1)
        objects += _font(sorted((code, c) for c, (own, code) in place.items() if own == f), len(objects) + 2)
    resources = b" ".join(b"/F%d %d 0 R" % (i, n) for i, n in enumerate(named))

    def shown(line: str) -> bytes:
        runs: list[tuple[int, bytearray]] = []
        for font, code in map(place.get, line):
            if not runs or runs[-1][0] != font:
                runs.append((font, bytearray()))
            runs[-1][1].append(code)
        return b" ".join(b"/F%d 10 Tf <%s> Tj" % (font, codes.hex().encode()) for font, codes in runs) + b" T*"

    kids = []
    for page in pages:
        body = b"BT 40 800 Td 14 TL " + b" ".join(map(shown, page)) + b" ET"
        objects.append(b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << " + resources + b" >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [" % len(kids) + b" ".join(b"%d 0 R" % k for k in kids) + b"] >>"
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


def bundle(result: Result) -> dict[str, bytes]:
    """K19."""
    return {"report.md": markdown(result).encode(), "report.jsonld": json_ld(result).encode(), "report.pdf": pdf(result)}


def cache_key(model: str, messages: list[dict], temperature: float) -> str:
    """K21, P22."""
    import hashlib

    return hashlib.sha256(json.dumps([model, messages, temperature], sort_keys=True, ensure_ascii=False).encode()).hexdigest()

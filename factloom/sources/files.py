"""Files and tables in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions.text import file_kind

EXTENSIONS = ("pdf", "docx", "doc", "pptx", "xlsx", "xls", "rtf", "txt", "html")


def corpus(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, cat, kind, length, content) of all files below a folder; the category is the
    first folder below it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.filter(F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin(*extensions))
    base = root.rstrip("/").rpartition("/")[2]
    cat = F.regexp_extract("path", f"/{base}/([^/]+)/", 1)
    return rows.select("path", cat.alias("cat"), file_kind(F.col("content"), F.col("path")).alias("kind"), "length", "content")


def texts(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """(path, text, error). `readers` maps a kind to a function of bytes; what has none, or
    fails, gives an error in its own column and no text. Plain text and HTML are built in, Word,
    slides and sheets are read from their XML."""
    own = {**BUILT_IN, **(readers or {})}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, errors = [], []
            for kind, content in zip(batch.column("kind").to_pylist(), batch.column("content").to_pylist()):
                try:
                    out.append(own[kind](content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one bad file must not stop the corpus
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return files.select("path", "kind", "content").mapInArrow(run, "path string, text string, error string")


def _plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def _markup(content: bytes) -> str:
    import html
    import re

    text = re.sub(r"(?is)<(script|style).*?</\1>|<!--.*?-->", " ", _plain(content))
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _said(block) -> str:
    return "".join(t.text or "" for t in block.iter() if _tag(t) == "t")


def _office(content: bytes) -> str:
    """Word paragraphs and tables, slides, and sheets, from the parts of the package."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        numbered = lambda pattern: sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        sheets = numbered(r"xl/worksheets/sheet\d+\.xml")
        if sheets:
            shared = [_said(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(e) == "si"] if "xl/sharedStrings.xml" in names else []
            return "\n".join(line for n in sheets[:SHEETS] for line in _sheet(z.read(n), shared))
        parts = [n for n in names if n == "word/document.xml"] or numbered(r"ppt/slides/slide\d+\.xml")
        out = []
        for name in parts:
            body = ElementTree.fromstring(z.read(name))
            in_cells = {p for row in body.iter() if _tag(row) == "tr" for p in row.iter() if _tag(p) == "p"}
            for block in body.iter():
                if _tag(block) == "tr":
                    out.append(" | ".join(" ".join(_said(p) for p in cell.iter() if _tag(p) == "p") for cell in block if _tag(cell) == "tc"))
                elif _tag(block) == "p" and block not in in_cells:
                    out.append(_said(block))
        return "\n".join(line for line in out if line.strip(" |"))


#: How much of a workbook is read.
SHEETS, SHEET_ROWS = 8, 60


def _sheet(part: bytes, shared: list[str]) -> list[str]:
    """The rows of a sheet, cells parted by tabs: shared, own and numeric values. A sheet that
    cannot be read is left out."""
    from xml.etree import ElementTree

    try:
        rows = [r for r in ElementTree.fromstring(part).iter() if _tag(r) == "row"][:SHEET_ROWS]
    except ElementTree.ParseError:
        return []
    out = []
    for row in rows:
        cells = []
        for cell in row:
            value = next((v.text for v in cell if _tag(v) == "v"), None)
            if cell.get("t") == "s" and value is not None:
                value = shared[int(value)] if int(value) < len(shared) else ""
            elif cell.get("t") == "inlineStr":
                value = _said(cell)
            cells.append(value or "")
        if any(cells):
            out.append("\t".join(cells))
    return out


#: Groups of RTF whose text is not the document's (fixed values).
RTF_ASIDE = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr headerf footerl footerr footerf generator themedata datastore xmlnstbl listtable listoverridetable rsidtbl object".split())


def _rtf(content: bytes) -> str:
    """The text of an RTF file: control words read, groups beside the text left out."""
    import re

    code = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
    page = re.search(rb"\\ansicpg(\d+)", content)
    charset = f"cp{page[1].decode()}" if page else "cp1252"
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    aside, skip, after = False, 1, 0
    raw = bytearray()

    def flush() -> None:
        if raw:
            out.append(raw.decode(charset, "replace"))
            raw.clear()

    for m in code.finditer(content):
        word, number, hexed, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append((aside, skip))
        elif brace == b"}":
            flush()
            aside, skip = stack.pop() if stack else (False, 1)
        elif sign == b"*" or word and word.decode() in RTF_ASIDE:
            aside = True
        elif aside:
            continue
        elif word in (b"par", b"line", b"sect", b"page", b"row"):
            flush()
            out.append("\n")
        elif word in (b"tab", b"cell"):
            flush()
            out.append("\t")
        elif word == b"uc":
            skip = int(number or 1)
        elif word == b"u" and number:
            flush()
            out.append(chr(int(number) % 65536))
            after = skip
        elif hexed:
            if after:
                after -= 1
            else:
                raw.append(int(hexed, 16))
        elif sign == b"~":
            raw += b" "
        elif sign in (b"\\", b"{", b"}"):
            raw += sign
        elif text:
            raw += text[after:]
            after = max(0, after - len(text))
    flush()
    whole = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return "\n".join(line.strip() for line in whole.split("\n") if line.strip())


BUILT_IN = {"txt": _plain, "html": _markup, "rtf": _rtf, "zip": _office, "docx": _office, "pptx": _office, "xlsx": _office}


def archive_members(files: DataFrame) -> DataFrame:
    """(path, content) of the members of archives split into .001, .002, ...: the parts of one
    archive, which was one file, are put together in one task."""
    parts = files.filter(F.col("path").rlike("\\.\\d{3}$"))
    keyed = parts.select(F.regexp_replace("path", "\\.\\d{3}$", "").alias("base"), F.regexp_extract("path", "\\.(\\d{3})$", 1).cast("int").alias("part"), "content")

    def run(table):
        import io
        import zipfile

        import pyarrow as pa

        table = table.sort_by("part")
        base = table.column("base")[0].as_py()
        rows = []
        with zipfile.ZipFile(io.BytesIO(b"".join(table.column("content").to_pylist()))) as z:
            rows = [{"path": f"{base} :: {n}", "content": z.read(n)} for n in z.namelist() if not n.endswith("/")]
        return pa.Table.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return keyed.groupBy("base").applyInArrow(run, "path string, content binary")


def json_lines(spark: SparkSession, path: str, schema: StructType, key: str | None = None) -> DataFrame:
    """Malformed lines are dropped; of rows with one key the last in the file counts."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if key is None:
        return rows
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_place").desc()))
    return rows.withColumn("_place", place).withColumn("_last", last).filter("_last = 1").drop("_last", "_place")


def modified_at(spark: SparkSession, path: str) -> float | None:
    """When a file or folder was last changed, in seconds; none if it is not there. The time
    of data of which no fact tells one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(where).getModificationTime() / 1000 if fs.exists(where) else None


def union_of_facts(*parts: DataFrame) -> DataFrame:
    """Facts of all tracks, absent columns null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def previews(texts_: DataFrame, doc_ids: DataFrame, n: int = 180) -> DataFrame:
    """The beginnings of a few texts: white space of the whole text is one blank each; of a
    text longer than n, n - 1 characters and an ellipsis."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    short = F.when(F.length(plain) > n, F.concat(F.rtrim(F.substring(plain, 1, n - 1)), F.lit("…"))).otherwise(plain)
    return texts_.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", short.alias("preview"))


def audit_sample(facts: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The same random facts at every run and partitioning: those with the smallest hashes."""
    return facts.orderBy(F.xxhash64(F.lit(seed), "pkey"), "pkey").limit(n)

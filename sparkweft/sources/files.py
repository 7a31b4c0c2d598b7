"""Readers and writers: documents, key-value files, graph files, exports, unique contexts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Extensions that hold text, and those that need a parser.
TEXT_EXTENSIONS = (
    "txt", "md", "mdx", "html", "htm", "tex", "json", "xml", "yaml", "yml", "rtf", "log", "conf", "ini", "properties", "sql", "bat", "sh", "c", "h", "cpp", "hpp",
    "py", "java", "js", "ts", "swift", "go", "rb", "php", "css", "scss", "less", "csv",
)
BINARY_EXTENSIONS = ("pdf", "docx", "pptx", "xlsx", "odt", "epub")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def new_files(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """(path, length, modificationTime, content) of supported files below a folder that are not in ``known(path)``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    d = d.where(extension(F.col("path")).isin(*TEXT_EXTENSIONS, *BINARY_EXTENSIONS))
    return d if known is None else d.join(known.select("path"), "path", "left_anti")


def decoded(files: DataFrame) -> DataFrame:
    """(path, content, error): text files as text, office files by their XML, others as errors.

    A file that is no valid UTF-8, is empty, or has no parser here becomes an
    error row, not a failed job.
    """
    @pandas_udf("struct<content string, error string>")
    def read(path: pd.Series, raw: pd.Series) -> pd.DataFrame:
        parse = {"pdf": lambda p, b: pdf_text(b)} | dict.fromkeys(BINARY_EXTENSIONS[1:], office_text)
        out = [parse.get(p.rsplit(".", 1)[-1].lower(), lambda p, b: plain_text(b))(p, b) for p, b in zip(path, raw)]
        return pd.DataFrame(out, columns=["content", "error"])

    return files.select("path", read("path", "content").alias("r")).select("path", "r.content", "r.error")


def plain_text(raw: bytes | None) -> tuple[str | None, str | None]:
    try:
        text = bytes(raw or b"").decode("utf-8")
    except UnicodeDecodeError:
        return None, "not UTF-8"
    return (text, None) if text.strip() else (None, "empty")


def cell_text(value: str) -> str:
    """One table cell on one line: backslashes first, then tabs and line ends."""
    return value.replace("\\", "\\\\").replace("\t", "\\t").replace("\r\n", "\\n").replace("\n", "\\n").replace("\r", "\\n")


def office_text(path: str, raw: bytes) -> tuple[str | None, str | None]:
    """Text of a word, slide or sheet file, read from the XML inside."""
    import io
    import zipfile
    from xml.etree import ElementTree

    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("docx", "pptx", "xlsx"):
        return None, f"no parser for {kind}"
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    said = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
            tree = lambda n: ElementTree.fromstring(z.read(n))
            names = z.namelist()
            number = lambda n: int("".join(c for c in n.rsplit("/", 1)[-1] if c.isdigit()) or 0)
            parts: list[str] = []
            if kind == "docx":
                for e in next(x for x in tree("word/document.xml") if local(x) == "body"):
                    if local(e) == "p":
                        parts.append(said(e))
                    elif local(e) == "tbl":
                        parts += ["\t".join(cell_text("\n".join(said(p) for p in c.iter() if local(p) == "p")) for c in row if local(c) == "tc") for row in e if local(row) == "tr"]
            elif kind == "pptx":
                for n in sorted((n for n in names if n.startswith("ppt/slides/slide")), key=number):
                    parts += [t for e in tree(n).iter() if local(e) == "p" and (t := said(e))]
            else:
                shared = [said(e) for e in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
                titles = [e.get("name") for e in tree("xl/workbook.xml").iter() if local(e) == "sheet"]
                for title, n in zip(titles, sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=number)):
                    parts.append(f"==== Sheet: {title} ====")
                    for row in (e for e in tree(n).iter() if local(e) == "row"):
                        cells = []
                        for c in row:
                            v = next((x.text or "" for x in c if local(x) == "v"), said(c))
                            cells.append(cell_text(shared[int(v)] if c.get("t") == "s" and v else v))
                        parts.append("\t".join(cells))
        text = "\n".join(parts)
        return (text, None) if text.strip() else (None, "empty")
    except Exception as e:  # noqa: BLE001  a damaged file is an error row
        return None, f"{type(e).__name__}: {e}"


#: Strings and operators of a page's content that show text or move to a new line.
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|\b(?:Tj|TJ|Td|TD|Tm|BT|ET)\b|T\*|['\"](?=\s)|-?\d+(?:\.\d+)?", re.DOTALL)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PDF_ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r") else m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.DOTALL)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def pdf_text(raw: bytes | None) -> tuple[str | None, str | None]:
    """Text of a PDF file: the strings its pages show, in order, for fonts in a Latin encoding. Encrypted files, and those that show no such text, are errors."""
    import zlib

    raw = bytes(raw or b"")
    if not raw.startswith(b"%PDF"):
        return None, "no PDF"
    if b"/Encrypt" in raw:
        return None, "encrypted"
    lines: list[str] = []
    for m in re.finditer(rb"(?<!end)stream\r?\n", raw):
        head = raw[max(0, raw.rfind(b"obj", 0, m.start())) : m.start()]
        end = raw.find(b"endstream", m.end())
        body = raw[m.end() : end if end >= 0 else len(raw)]
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body or b"ET" not in body:
            continue
        said, held, line, inside = [], [], "", False
        for t in _SHOWN.findall(body):
            if t in (b"BT", b"ET", b"Td", b"TD", b"T*", b"Tm", b"'", b'"'):
                if line and t != b"BT":
                    said.append(line)
                    line = ""
                if t in (b"'", b'"') and held:
                    line = held[-1]
                held = []
            elif t in (b"Tj", b"TJ"):
                line += "".join(held)
                held = []
            elif t == b"[" or t == b"]":
                inside = t == b"["
            elif t[:1] in (b"(", b"<"):
                held.append(_pdf_string(t))
            elif inside and float(t) < -200:  # a gap as wide as a blank
                held.append(" ")
        lines += [x for x in (*said, line) if x.strip()]
    text = "\n".join(lines)
    return (text, None) if text.strip() else (None, "no text")


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """(id, value as JSON) of a JSON object file; values of any shape."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "value"))


def write_kv(table: DataFrame, path: str, key: str = "id") -> None:
    """One JSON line a key."""
    rest = [c for c in table.columns if c != key]
    table.select(F.to_json(F.map_from_arrays(F.array(F.col(key).cast("string")), F.array(F.struct(*rest)))).alias("value")).write.mode("overwrite").text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table behind JDBC. With a numeric key it is read in ``parts`` ranges between the key's ends, which the database tells; filters and columns reach the database."""
    read = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    whole = read().option("dbtable", table)
    if key is None:
        return whole.load()
    low, high = read().option("query", f"select min({key}) as a, max({key}) as b from {table}").load().first()
    if low is None:
        return whole.load()
    return whole.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high + 1)).option("numPartitions", str(parts)).load()


def write_jdbc(table: DataFrame, url: str, name: str, mode: str = "append", parts: int = 8, **options: str) -> None:
    """A table to a database, over at most ``parts`` connections."""
    table.write.format("jdbc").option("url", url).option("dbtable", name).option("numPartitions", str(parts)).options(**options).mode(mode).save()


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(name, data map), edges(src, tgt, data map)) of a GraphML file, attributes under their key ids."""
    data = "array<struct<_key:string,_VALUE:string>>"
    pairs = lambda: F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(data)), lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("data")
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    e = edges.select(F.least("_source", "_target").alias("src"), F.greatest("_source", "_target").alias("tgt"), pairs())
    return nodes.select(F.col("_id").alias("name"), pairs()), e


def _xml(c: Column) -> Column:
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The elements of a GraphML file, one a row; edges carry their weight as key d0."""
    n = nodes.select(F.concat(F.lit('<node id="'), _xml(F.col("name")), F.lit('"/>')).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("tgt")), F.lit('"><data key="d0">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    return n.unionByName(e)


def unique_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, context) of JSON-lines files: distinct contexts by first appearance, bad lines left out."""
    d = spark.read.schema("context string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    d = d.select("context", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).where("context is not null")
    first = d.groupBy("file", "context").agg(F.min("at").alias("at"))
    return first.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("long").alias("pos"), "context")


EXPORTS = ("csv", "txt", "md", "json", "parquet", "xlsx")
#: Rows that a sheet can hold.
SHEET_ROWS = 1_048_576


def write_xlsx(tables: dict[str, DataFrame], path: str) -> None:
    """One workbook with a sheet a table, header first. A table that a sheet cannot hold is an error; rows stream through the driver."""
    import tempfile
    import zipfile

    spark = next(iter(tables.values())).sparkSession
    for name, d in tables.items():
        if d.limit(SHEET_ROWS).count() == SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet can hold")
    escape = lambda v: re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    row = lambda values: f"<row>{''.join(map(cell, values))}</row>".encode()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    package = "http://schemas.openxmlformats.org/package/2006"
    many = range(1, len(tables) + 1)
    with tempfile.NamedTemporaryFile(suffix=".xlsx") as local:
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in many) + "</Types>")
            z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in many) + "</Relationships>")
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(tables, 1)) + "</sheets></workbook>")
            for i, d in enumerate(tables.values(), 1):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                    out.write(f'<worksheet xmlns="{main}"><sheetData>'.encode() + row(d.columns))
                    for r in d.toLocalIterator():
                        out.write(row(r))
                    out.write(b"</sheetData></worksheet>")
        local.flush()
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local.name}"), to)


def _flat(d: DataFrame) -> DataFrame:
    """Nested columns as JSON."""
    return d.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in d.dtypes])


def export(entities: DataFrame, relations: DataFrame, path: str, kind: str = "csv") -> None:
    """Entities and relations (both directions of a pair stay one row) below a folder, in one of the formats."""
    if kind not in EXPORTS:
        raise ValueError(f"unsupported format {kind}; one of {', '.join(EXPORTS)}")
    if kind == "xlsx":
        return write_xlsx({"entities": _flat(entities), "relations": _flat(relations)}, f"{path}.xlsx" if not path.endswith(".xlsx") else path)
    for name, d in (("entities", entities), ("relations", relations)):
        to = f"{path}/{name}"
        if kind in ("json", "parquet"):
            d.write.mode("overwrite").format(kind).save(to)
        elif kind == "csv":
            _flat(d).write.mode("overwrite").option("header", "true").csv(to)
        else:
            sep = " | " if kind == "md" else "\t"
            cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _flat(d).columns]
            line = F.concat_ws(sep, *cols)
            _flat(d).select((F.concat(F.lit("| "), line, F.lit(" |")) if kind == "md" else line).alias("value")).write.mode("overwrite").text(to)


def copy_workspace(table: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of one workspace under another's name."""
    return table.where(F.col("workspace") == old).withColumn("workspace", F.lit(new))


def encode_vectors(df: DataFrame, column: str = "v") -> DataFrame:
    """Vectors as base64 of zlib of 16-bit floats: small, and lossy."""
    @pandas_udf("string")
    def pack(v: pd.Series) -> pd.Series:
        import base64
        import zlib

        import numpy as np

        return v.map(lambda x: None if x is None else base64.b64encode(zlib.compress(np.asarray(x, np.float16).tobytes())).decode())

    return df.withColumn(column, pack(column))


def decode_vectors(df: DataFrame, column: str = "v") -> DataFrame:
    @pandas_udf("array<float>")
    def unpack(v: pd.Series) -> pd.Series:
        import base64
        import zlib

        import numpy as np

        return v.map(lambda x: None if x is None else np.frombuffer(zlib.decompress(base64.b64decode(x)), np.float16).astype(np.float32))

    return df.withColumn(column, unpack(column))

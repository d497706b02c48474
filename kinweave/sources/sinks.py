"""Writers of all outputs: folders of part files, and reports of one-row frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import one_decimal, safe_filename


def write_tsv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.csv(path, sep="\t", header=True, mode="overwrite", compression=compression)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.csv(path, header=True, mode="overwrite", compression=compression)


def write_scores(scores: DataFrame, path: str) -> None:
    write_tsv(scores.withColumn("s_AB", one_decimal(F.col("s_AB"))), path)


def write_fasta(sequences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """sequences: (category, accession, description, sequence); one folder for each category and accession."""
    text = F.concat(F.lit(">"), F.col("description"), F.lit("\n"), F.col("sequence"))
    sequences.select("category", safe_filename(F.col("accession")).alias("accession"), text.alias("value")).write.mode(mode).partitionBy("category", "accession").text(path)


def write_genbank(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """records: (category, accession, body) of flat files as they are; one folder for each category and accession."""
    records.select("category", safe_filename(F.col("accession")).alias("accession"), F.regexp_replace("body", r"\n$", "").alias("value")).write.mode(mode).partitionBy("category", "accession").text(path)


def write_nodes(nodes: DataFrame, path: str, compression: str = "none") -> None:
    """By id, in order of code points: CHG_10 stands before CHG_2. A total order over part files, by ranges."""
    write_csv(nodes.orderBy("type", "node_id") if "type" in nodes.columns else nodes.orderBy("node_id"), path, compression)


def write_edges(edges: DataFrame, path: str, compression: str = "none") -> None:
    write_csv(edges.orderBy("source", "target"), path, compression)


def write_transfers(hits: DataFrame, path: str, compression: str = "none") -> None:
    """By cluster and taxon pair."""
    write_tsv(hits.orderBy("chg", "taxon_pair", "query", "target"), path, compression)


def write_workbook(df: DataFrame, path: str) -> None:
    """An .xlsx workbook of one sheet: a header, then a row for each row of df as text. For tables of dimension size, such as metadata of records."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def letters(k: int) -> str:
        return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    def row(i: int, values) -> str:
        cells = "".join(f'<c r="{letters(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for k, v in enumerate(values) if v is not None)
        return f'<row r="{i}">{cells}</row>'

    rows = [row(1, df.columns), *[row(i + 2, r) for i, r in enumerate(df.toLocalIterator())]]
    main, rels, head = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", '<?xml version="1.0" encoding="UTF-8"?>'
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, head + text)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def thresholds(bounds: DataFrame) -> DataFrame:
    """One row: point, lower, upper, description; bounds: (quantile, point, lower, upper)."""
    text = F.concat(F.lit("Bootstrap interval of the "), (F.col("quantile") * 100).cast("int").cast("string"), F.lit(" % quantile"))
    return bounds.select("point", "lower", "upper", text.alias("description"))


def _facts(df: DataFrame) -> list[str]:
    row = df.first()
    return [f"  {k:<22}{v:.6g}" if isinstance(v, float) else f"  {k:<22}{v}" for k, v in (row.asDict() if row else {}).items()]


def report(method: str, described: DataFrame, fits: DataFrame, bounds: DataFrame, candidates: int, total: int) -> str:
    """Five sections: the method, statistics, fits (best first), the threshold, the candidates."""
    best = fits.collect()
    lines = ["SCORE ANALYSIS", f"  method                {method}", "", "DESCRIPTIVE STATISTICS", *_facts(described), "", "DISTRIBUTION FITS"]
    lines += [f"  {r['name']:<14}KS {r['ks']:.4f}  p {r['p_value']:.4g}  {r['quality']}" for r in best]
    lines += [f"  best                  {best[0]['name']}"] if best else []
    share = 100 * candidates / total if total else 0.0
    return "\n".join([*lines, "", "THRESHOLD", *_facts(bounds), "", "CANDIDATES", f"  above the upper bound {candidates} of {total} ({share:.2f} %)"]) + "\n"

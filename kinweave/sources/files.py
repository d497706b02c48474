"""Readers of all file formats, as DataFrames with fixed schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import accession_of_file, accession_of_organism, accessions, normalize_taxid, product_of, protein_key, safe_int


def _line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one small file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\r?\n")).alias("line", "value"))


def read_inputfile(spark: SparkSession, path: str) -> DataFrame:
    """(line, name, sequence): the first and the last word of each line after the header; lines of one word are skipped."""
    words = F.split(F.trim("value"), r"\s+")
    d = _line_numbers(spark, path).where("line > 0").select("line", words.alias("w")).where(F.size("w") >= 2)
    return d.select("line", F.get("w", F.lit(0)).alias("name"), F.element_at("w", -1).alias("sequence"))


def name_map(records: DataFrame) -> DataFrame:
    """(line, genome_accession, organism_name, sequence): of repeated organisms the first line and the last sequence."""
    d = records.groupBy(accession_of_organism(F.col("name")).alias("genome_accession")).agg(F.min("line").alias("line"), F.max_by("name", "line").alias("organism_name"), F.max_by("sequence", "line").alias("sequence"))
    return d.select("line", "genome_accession", "organism_name", "sequence")


def read_fasta(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, record, id, description, sequence); record counts from 1 in each file.

    Files are read by records, so a large one is split over tasks; a record must fit a row.
    """
    more = {"pathGlobFilter": glob, "recursiveFileLookup": True} if glob else {}
    d = spark.read.text(path, lineSep="\n>", **more)
    d = d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("r"))
    # the separator takes the mark of all records but a file's first; blocks number their own records, then are added up
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("file", "b").orderBy("i")))
    first = (F.col("b") == 0) & (F.col("k") == 1)
    d = d.where(~first | F.startswith("r", F.lit(">"))).withColumn("r", F.when(first, F.substring("r", F.lit(2), F.length("r"))).otherwise(F.col("r")))
    sizes = d.groupBy("file", "b").agg(F.count("*").alias("n"), F.min("k").alias("low"))
    upto = Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "b", "low", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    d = d.join(sizes, ["file", "b"]).withColumn("record", (F.col("base") + F.col("k") - F.col("low") + 1).cast("int"))
    head = F.regexp_replace(F.regexp_extract("r", r"^([^\n]*)", 1), "\r", "")
    return d.select("file", "record", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("description"), F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n?(.*)$", 1), r"\s", "").alias("sequence"))


def read_protein_folders(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """FASTA records of ``*_proteins.faa`` by category, with protein ids and products; missing folders are skipped."""
    out = None
    jvm = spark._jvm
    for category, folder in folders.items():
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            continue
        d = read_fasta(spark, folder, "*_proteins.faa").withColumn("taxon", F.lit(category))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return spark.createDataFrame([], "protein_id string, genome_accession string, taxon string, product string, sequence string, record int, file string")
    genome, product = accession_of_file(F.col("file")), product_of(F.col("description"))
    return out.select(protein_key(F.col("taxon"), genome, F.col("id"), product, F.col("record")).alias("protein_id"), genome.alias("genome_accession"), "taxon", product.alias("product"), "sequence", "record", "file")


def count_sequences(spark: SparkSession, folder: str, suffix: str = ".faa") -> DataFrame:
    """(file_name, n_sequences) of every file with the suffix, by name; -1 for a file that is not FASTA. Lines are counted where they are read."""
    d = spark.read.text(folder, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    d = d.where(F.lower("file_name").endswith(suffix.lower())).where(F.trim("value") != "")
    first = F.min_by(F.startswith(F.trim("value"), F.lit(">")), F.struct("b", "i"))
    d = d.groupBy(_place(F.col("p")).alias("p")).agg(F.count_if(F.startswith("value", F.lit(">"))).cast("int").alias("n"), first.alias("fasta"))
    every = spark.createDataFrame(_listed(spark, folder, suffix), "uri string, file_name string").select(_place(F.col("uri")).alias("p"), "file_name").join(d, "p", "left")
    return every.select("file_name", F.when(F.col("fasta"), F.col("n")).when(F.col("n").isNull(), 0).otherwise(-1).cast("int").alias("n_sequences")).orderBy("file_name")


def _place(uri: Column) -> Column:
    """A file's URI with one slash behind the scheme, as listings and readers write it differently."""
    return F.regexp_replace(uri, "^([a-z0-9]+:)/+", "$1/")


def _listed(spark: SparkSession, folder: str, suffix: str) -> list[tuple[str, str]]:
    """(URI, name) of the files below a folder, empty ones too, which readers leave out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().lower().endswith(suffix.lower()):
            out.append((path.toUri().toString(), path.getName()))
    return out


def totals_by_category(counts: DataFrame, categories: list[str]) -> DataFrame:
    """(category, n_files, total_proteins), zeros for categories without files; counts: (category, n_sequences)."""
    base = counts.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    d = counts.groupBy("category").agg(F.count("*").alias("n_files"), F.sum(F.greatest("n_sequences", F.lit(0))).alias("total_proteins"))
    return base.join(d, "category", "left").fillna(0, ["n_files", "total_proteins"])


def _csv(spark: SparkSession, path: str, schema: str, sep: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def read_hits(spark: SparkSession, path: str, header: bool = True, max_rows: int | None = None) -> DataFrame:
    """All hits, or the first ``max_rows`` in order of the files' names and of the rows in them; readers take larger files first."""
    if max_rows is None:
        return _csv(spark, path, schemas.HITS, "\t", header)
    return _ordered(spark, path, schemas.HITS, "\t", header).orderBy("_seq").limit(max_rows).drop("_seq")


def read_edges_of_hits(spark: SparkSession, path: str, header: bool = True, max_rows: int | None = None) -> DataFrame:
    return read_hits(spark, path, header, max_rows).select("query", "target").where("query is not null and target is not null")


def _ordered(spark: SparkSession, path: str, schema: str, sep: str, header: bool = True) -> DataFrame:
    """Rows with _seq, which ascends with the place of a row in the files, in order of their names."""
    d = spark.read.csv(path, schema=schema, sep=sep, header=header)
    return d.withColumn("_seq", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the last row."""
    rest = [c for c in rows.columns if c not in (*keys, "_seq")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_r")).select(*keys, "_r.*")


def _without_header(rows: DataFrame, *names: str) -> DataFrame:
    """Rows but for those that only repeat the columns' names: a header, where a file has one."""
    is_header = F.lit(True)
    for c in names:
        is_header = is_header & (F.col(c) == c)
    return rows.where(~F.coalesce(is_header, F.lit(False)))


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """Unordered pairs; of repeated ones the last row counts."""
    d = _ordered(spark, path, schemas.DISTANCES, "\t").where("genome_a is not null and genome_b is not null and N_int is not null")
    return _last(d.select(F.least("genome_a", "genome_b").alias("genome_a"), F.greatest("genome_a", "genome_b").alias("genome_b"), "N_int", "_seq"), "genome_a", "genome_b")


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, genome_accession, taxon), with or without a header; of repeated proteins the last row counts."""
    d = _without_header(_ordered(spark, path, schemas.PROTEINS, ",", False), "protein_id", "genome_accession")
    return _last(d.where("protein_id is not null and genome_accession is not null"), "protein_id")


def read_taxon_of_genome(spark: SparkSession, path: str) -> DataFrame:
    """(genome_accession, category): the lower-cased taxon of the genome's last row, with or without a header."""
    d = _without_header(_ordered(spark, path, schemas.PROTEINS, ",", False), "protein_id", "genome_accession").where("genome_accession is not null")
    return _last(d.select("genome_accession", F.lower("taxon").alias("category"), "_seq"), "genome_accession")


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, chg_id), the first two columns, with or without a header; of repeated proteins the last row counts."""
    d = _ordered(spark, path, schemas.MEMBERSHIP, "\t", False)
    return _last(d.where("protein_id is not null and chg_id is not null and chg_id <> 'chg_id'"), "protein_id")


def read_taxids(spark: SparkSession, path: str) -> DataFrame:
    """(genome_accession, organism_name, taxid); rows without a third column go, of repeated genomes the last row counts."""
    return _last(_ordered(spark, path, schemas.TAXIDS, ",").where("genome_accession is not null and taxid is not null"), "genome_accession")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SCORES, "\t")


def with_node_defaults(raw: DataFrame) -> DataFrame:
    """node_id (or genome_accession), type (genome if there is a category), category, color; rows without an id go."""
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    d = raw.select(
        F.coalesce(have("node_id"), have("genome_accession")).alias("node_id"), F.coalesce(have("type"), F.when(have("category").isNotNull(), "genome").otherwise("CHG")).alias("type"),
        F.coalesce(have("category"), F.lit("")).alias("category"), F.coalesce(have("color"), F.lit("#bbbbbb")).alias("color"),
    )
    return d.where("node_id is not null")


def with_edge_defaults(raw: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("weight").try_cast("int"), F.lit(1)) if "weight" in raw.columns else F.lit(1)
    return raw.select("source", "target", weight.alias("weight"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return with_node_defaults(spark.read.csv(path, header=True))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return with_edge_defaults(spark.read.csv(path, header=True))


def read_json_scalars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an .xlsx workbook, all columns strings by the names of its first row. A workbook is of dimension size."""
    import io
    import zipfile
    from xml.etree import ElementTree

    content = spark.read.format("binaryFile").load(path).first()["content"]
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    book = zipfile.ZipFile(io.BytesIO(bytes(content)))
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{ns}t"))
    shared = [text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")] if "xl/sharedStrings.xml" in book.namelist() else []
    sheet = min((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
    table = []
    for row in ElementTree.fromstring(book.read(sheet)).iter(f"{ns}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{ns}c"):
            place = 0
            for letter in re.match("[A-Z]*", c.get("r", "")).group():
                place = place * 26 + ord(letter) - 64
            value = c.find(f"{ns}v")
            own = text(c) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
            if own is not None:
                cells[place - 1 if place else len(cells)] = own
        table.append(cells)
    names = table[0] if table else {}
    schema = ", ".join(f"`{names[k]}` string" for k in sorted(names)) or "`none` string"
    return spark.createDataFrame([tuple(r.get(k) for k in sorted(names)) for r in table[1:]], schema)


def read_organisms(spark: SparkSession, path: str, category: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Records of a workbook, or of a CSV file with the same columns; a missing file has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    columns = columns or PRESETS[category]
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return organism_records(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns.values())), category, columns)
    return organism_records(read_workbook(spark, path) if path.endswith(".xlsx") else spark.read.csv(path, header=True), category, columns)


def organism_records(rows: DataFrame, category: str, columns: dict[str, str]) -> DataFrame:
    """(uniq_id, organism, taxid, category, accessions, additional); rows without an accession go.

    columns: names of accession, uniq_id, organism, taxid, plasmid, genes, proteins, where they exist.
    """
    have = lambda k: F.col(f"`{columns[k]}`").cast("string") if columns.get(k) in rows.columns else F.lit(None).cast("string")
    main, plasmid = have("accession"), have("plasmid") if columns.get("plasmid") in rows.columns else None
    extra = F.create_map(F.lit("_expected_genes"), safe_int(have("genes")).cast("string"), F.lit("_expected_proteins"), safe_int(have("proteins")).cast("string"))
    d = rows.select(F.coalesce(have("uniq_id"), main).alias("uniq_id"), F.coalesce(have("organism"), F.lit("Unknown")).alias("organism"), normalize_taxid(have("taxid")).alias("taxid"), F.lit(category).alias("category"), accessions(main, plasmid).alias("accessions"), F.map_filter(extra, lambda _, v: v.isNotNull()).alias("additional"))
    return d.where(F.size("accessions") > 0)


def records_of_accessions(spark: SparkSession, name: str, given: list[str]) -> DataFrame:
    d = spark.createDataFrame([(i + 1, a) for i, a in enumerate(given)], "i int, a string")
    return d.select(F.concat_ws("_", F.lit(name), F.col("i").cast("string")).alias("uniq_id"), F.lit("Unknown").alias("organism"), F.lit(None).cast("string").alias("taxid"), F.lit(name).alias("category"), F.array("a").alias("accessions"), F.create_map().cast("map<string,string>").alias("additional"))


def primary_accession(records: DataFrame) -> DataFrame:
    return records.withColumns({"primary": F.try_element_at("accessions", F.lit(1)), "has_multiple": F.size("accessions") > 1})


#: Source column names of the four bundled dataset kinds.
PRESETS = {
    "archaea": {"accession": "Chromosomes/RefSeq", "uniq_id": "UniqID", "organism": "Organism/Name", "taxid": "TaxID", "plasmid": "Plasmids/RefSeq", "genes": "Genes", "proteins": "Proteins"},
    "bacteria": {"accession": "Chromosomes/RefSeq", "uniq_id": "UniqID", "organism": "Organism/Name", "taxid": "TaxID", "plasmid": "Plasmids/RefSeq", "genes": "Genes", "proteins": "Proteins"},
    "plasmid": {"accession": "RefSeq", "uniq_id": "UniqID", "organism": "Organism/Name", "taxid": "TaxID", "genes": "Genes", "proteins": "Proteins"},
    "virus": {"accession": "BioProject Accession", "uniq_id": "UniqID", "organism": "Organism/Name", "taxid": "TaxID"},
}


def parse_genbank(text: str) -> list[dict]:
    """All records of a flat file: accession, definition, organism, lineage, xrefs, sequence, features."""
    out = []
    for raw in re.split(r"(?m)^//\s*$", text):
        if not raw.strip():
            continue
        r: dict = {"accession": "", "definition": "", "organism": "", "lineage": [], "xrefs": [], "features": [], "sequence": ""}
        section = ""
        for line in raw.splitlines():
            key, body = line[:12].strip(), line[12:].strip()
            if line[:1].strip():
                section = key.split()[0] if key else ""
            if section == "ORIGIN" and not line[:1].strip():
                r["sequence"] += re.sub(r"[^A-Za-z]", "", line)
            elif section == "FEATURES" and not line[:1].strip():
                kind, rest = line[5:21].strip(), line[21:].strip()
                if kind:
                    r["features"].append({"kind": kind, "location": rest, "qualifiers": {}, "_open": None})
                elif r["features"]:
                    f = r["features"][-1]
                    if rest.startswith("/"):
                        name, _, value = rest[1:].partition("=")
                        value = value.strip()
                        quoted = value.startswith('"') and not (len(value) > 1 and value.endswith('"'))
                        value = value.strip('"')
                        f["qualifiers"][name] = f"{f['qualifiers'][name]};{value}" if name in f["qualifiers"] else value
                        f["_open"] = name if quoted else None
                        f["_any"] = True
                    elif f["_open"]:
                        name = f["_open"]
                        glue = "" if name == "translation" else " "
                        f["qualifiers"][name] += glue + rest.strip('"')
                        if rest.endswith('"'):
                            f["_open"] = None
                    elif not f.get("_any"):
                        f["location"] += rest
            elif key == "ACCESSION":
                r["accession"] = body.split()[0] if body else ""
            elif key == "VERSION" and body:
                r["accession"] = body.split()[0]
            elif key == "DEFINITION":
                r["definition"] = body
            elif key == "DBLINK" or section == "DBLINK":
                r["xrefs"] += [re.sub(r"\s+", "", body)] if body else []
            elif key == "ORGANISM":
                r["organism"], section = body, "ORGANISM"
            elif section == "ORGANISM" and body:
                r["lineage"] += [x.strip(" .") for x in body.split(";") if x.strip(" .")]
        for f in r["features"]:
            f.pop("_open", None), f.pop("_any", None)
        out.append(r)
    if not out:
        raise ValueError("no GenBank record")
    return out


GENBANK = "accession string, definition string, organism string, lineage array<string>, xrefs array<string>, features array<struct<kind:string,location:string,qualifiers:map<string,string>>>, sequence string"


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """The records of flat files. Files are split at the ends of records, so that a large file is read by many tasks, a record at a time."""
    texts = spark.read.text(path, lineSep="\n//").where(r"value rlike '\\S'")

    def run(batches):
        import pyarrow as pa

        kv = pa.map_(pa.string(), pa.string())
        kind = pa.schema([("accession", pa.string()), ("definition", pa.string()), ("organism", pa.string()), ("lineage", pa.list_(pa.string())), ("xrefs", pa.list_(pa.string())), ("features", pa.list_(pa.struct([("kind", pa.string()), ("location", pa.string()), ("qualifiers", kv)]))), ("sequence", pa.string())])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = parse_genbank(text)
                for r in rows:
                    for f in r["features"]:
                        f["qualifiers"] = list(f["qualifiers"].items())
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return texts.mapInArrow(run, GENBANK)


#: The standard genetic code, bases in order TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_dna(dna: str) -> str:
    """Amino acids up to the first stop."""
    at = {b: i for i, b in enumerate("TCAG")}
    dna, out = dna.upper().replace("U", "T"), []
    for i in range(0, len(dna) - 2, 3):
        codon = [at.get(b) for b in dna[i : i + 3]]
        aa = "X" if None in codon else CODE[codon[0] * 16 + codon[1] * 4 + codon[2]]
        if aa == "*":
            break
        out.append(aa)
    return "".join(out)


def extract_dna(sequence: str, location: str) -> str:
    """The bases of a location with ranges, join and complement."""
    location = re.sub(r"[<>\s]", "", location)
    if location.startswith("complement("):
        inner = extract_dna(sequence, location[11:-1])
        return inner[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    if location.startswith(("join(", "order(")):
        parts, depth, now = [], 0, ""
        for c in location[location.index("(") + 1 : -1]:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(now)
                now = ""
            else:
                now += c
        return "".join(extract_dna(sequence, p) for p in [*parts, now])
    m = re.fullmatch(r"(\d+)(?:\.\.(\d+))?", location)
    return sequence[int(m[1]) - 1 : int(m[2] or m[1])] if m else ""


def genbank_proteins(records: DataFrame) -> DataFrame:
    """(accession, protein_id, product, sequence) of coding features: their translation, else that of their bases."""
    d = records.select("accession", F.col("sequence").alias("dna"), F.explode("features").alias("f")).where("f.kind = 'CDS'")
    translated = F.udf(lambda dna, where: translate_dna(extract_dna(dna or "", where or "")), "string", useArrow=True)
    q = F.col("f.qualifiers")
    return d.select("accession", F.coalesce(q["protein_id"], F.lit("unknown")).alias("protein_id"), F.coalesce(q["product"], F.lit("hypothetical protein")).alias("product"), F.coalesce(q["translation"], translated(F.col("dna"), F.col("f.location"))).alias("sequence"))


def genbank_genes(records: DataFrame) -> DataFrame:
    """(accession, type, locus_tag, gene, location, protein_id, product): gene features, or coding ones where there are none."""
    some = F.exists("features", lambda f: f["kind"] == "gene")
    kind = F.when(some, "gene").otherwise("CDS")
    d = records.select("accession", kind.alias("k"), F.explode("features").alias("f")).where("f.kind = k")
    q = F.col("f.qualifiers")
    wide = lambda n: F.when(F.col("k") == "CDS", F.coalesce(q[n], F.lit(""))).alias(n)
    return d.select("accession", F.col("k").alias("type"), F.coalesce(q["locus_tag"], F.lit("")).alias("locus_tag"), F.coalesce(q["gene"], F.lit("")).alias("gene"), F.col("f.location").alias("location"), wide("protein_id"), wide("product"))


def genbank_metadata(records: DataFrame, category: str) -> DataFrame:
    """The columns of the category (plasmid, virus, archaea or bacteria, else basic)."""
    from ..functions.scalars import gc_percent, phylum, size_kb, size_mb

    source = F.get(F.filter("features", lambda f: f["kind"] == "source"), F.lit(0))["qualifiers"]
    xref = lambda p: F.nullif(F.regexp_extract(F.array_join("xrefs", ";"), p, 1), F.lit(""))
    seq, taxid = F.col("sequence"), F.nullif(F.regexp_extract(F.coalesce(source["db_xref"], F.lit("")), r"taxon:(\d+)", 1), F.lit(""))
    named = {"Organism/Name": F.col("organism"), "TaxID": taxid}
    project = {"BioProject Accession": xref(r"BioProject:([^;]+)"), "BioProject ID": xref(r"PRJNA(\d+)")}
    groups = {"Group": F.get("lineage", F.lit(0)), "SubGroup": F.get("lineage", F.lit(2))}
    if category == "plasmid":
        own = {"RefSeq": F.col("accession"), **named, "GenBank": F.col("accession"), "HostName": source["host"]}
    elif category == "virus":
        own = {**named, **project, **groups, "GC%": gc_percent(seq), "Status": F.lit("Complete"), "Size (Kb)": size_kb(seq), "Host": source["host"]}
    elif category in ("archaea", "bacteria"):
        own = {**named, **project, **groups, "Phylum": phylum(F.col("lineage")), "Size (Mb)": size_mb(seq), "GC%": gc_percent(seq), "Chromosomes/RefSeq": F.col("accession"), "Status": F.lit("Complete"), "BioSample Accession": F.coalesce(xref(r"BioSample:([^;]+)"), F.lit("-")), "Habitats": source["isolation_source"], "Host": source["host"]}
    else:
        own = {"Accession": F.col("accession"), **named, "GC%": gc_percent(seq, 2), "Size (Mb)": size_mb(seq, 2)}
    return records.select(*[c.alias(k) for k, c in own.items()])


def combine_chromosomes(records: DataFrame, order: str = "part") -> DataFrame:
    """One row for each organism: sequences joined in order, sizes added, the first part's accession; records: (organism, part, accession, sequence)."""
    d = records.groupBy("organism").agg(F.array_sort(F.collect_list(F.struct(order, "sequence"))).alias("s"), F.min_by("accession", order).alias("accession"), F.count("*").alias("n_parts"))
    return d.select("organism", "accession", "n_parts", F.array_join(F.transform("s", lambda x: x["sequence"]), "").alias("sequence")).withColumn("Size(Mb)", F.bround(F.length("sequence") / 1e6, 4))


def missing_files(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(category, accession) that no file of the cache answers."""
    return wanted.join(existing.select("category", "accession").distinct(), ["category", "accession"], "left_anti")


def cached_accessions(spark: SparkSession, folder: str, category: str, suffix: str = ".fasta") -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return d.select(F.lit(category).alias("category"), F.regexp_extract("path", r"([^/]*)" + re.escape(suffix) + "$", 1).alias("accession"))


def count_deviation(results: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Results with ok: found is within the tolerance of expected; null without an expectation."""
    return results.withColumn("ok", F.when(F.col("expected") > 0, F.abs(F.col("found") - F.col("expected")) <= tolerance * F.col("expected")))


def first_hit(candidates: DataFrame) -> DataFrame:
    """The accession of the lowest query rank that has one; candidates: (uniq_id, query_rank, accession)."""
    return candidates.where("accession is not null").groupBy("uniq_id").agg(F.min_by("accession", "query_rank").alias("accession"))


#: Sample attributes and the columns they fill.
SAMPLE_ATTRIBUTES = {
    "strain": "Strain",
    "isolation_source": "Habitats",
    "host": "Host",
    "collection_date": "Collection Date",
    "geo_loc_name": "Geographic Location",
    "temperature": "Temperature Optimum",
    "gram_stain": "Gram Stain",
    "cell_shape": "Cell Shape",
    "motility": "Motility",
    "sporulation": "Sporulation",
    "oxygen_requirement": "Oxygen Requirement",
    "salinity": "Salinity",
    "ph": "Ph",
    "phenotype": "Phenotypes",
}


def sample_attributes(attributes: DataFrame) -> DataFrame:
    """One row for each sample; attributes: (sample, name, value)."""
    names = F.create_map(*[x for k, v in SAMPLE_ATTRIBUTES.items() for x in (F.lit(k), F.lit(v))])
    d = attributes.withColumn("column", F.element_at(names, F.lower("name"))).where("column is not null")
    return d.groupBy("sample").pivot("column", list(SAMPLE_ATTRIBUTES.values())).agg(F.first("value"))

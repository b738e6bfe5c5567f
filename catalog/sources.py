"""Source files, manifests and configuration files built from rows of the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# A block of source text per language, and the definitions in it as
# (name, kind, first line, last line, signature) with lines counted inside the block.
BLOCKS: dict[str, tuple[str, list[str], list[tuple[str, str, int, int, str]]]] = {
    "python": (
        "py",
        [
            "class Widget_{i}:",
            "    def make_{i}(self, x):",
            '        return "{" + str(x)',
            "",
            "    # note {i}",
        ],
        [
            ("Widget_{i}", "class", 1, 5, "class Widget_{i}:"),
            ("make_{i}", "function", 2, 3, "def make_{i}(self, x):"),
        ],
    ),
    "javascript": (
        "js",
        [
            "export async function load_{i}(a) {",
            "  const s = \"}}\"; // }",
            "}",
            "const pick_{i} = async (b) => {",
            "  return `}`;",
            "};",
        ],
        [
            ("load_{i}", "function", 1, 3, "export async function load_{i}(a) {"),
            ("pick_{i}", "function", 4, 6, "const pick_{i} = async (b) => {"),
        ],
    ),
    "typescript": (
        "ts",
        ["export class Box_{i} {", "  open(c: string) { return '{'; }", "}"],
        [("Box_{i}", "class", 1, 3, "export class Box_{i} {")],
    ),
    "rust": (
        "rs",
        [
            "pub struct Point_{i} {",
            "    x: f64, // {",
            "}",
            "pub fn go_{i}(v: &str) -> i32 {",
            "    if v == \"{\" { 1 } else { 2 }",
            "}",
        ],
        [
            ("Point_{i}", "class", 1, 3, "pub struct Point_{i} {"),
            ("go_{i}", "function", 4, 6, "pub fn go_{i}(v: &str) -> i32 {"),
        ],
    ),
    "go": (
        "go",
        [
            "type Tree_{i} struct {",
            "    n int",
            "}",
            "func (t *Tree_{i}) Run_{i}(s string) {",
            "    fmt.Println(\"}\")",
            "}",
        ],
        [
            ("Tree_{i}", "class", 1, 3, "type Tree_{i} struct {"),
            ("Run_{i}", "function", 4, 6, "func (t *Tree_{i}) Run_{i}(s string) {"),
        ],
    ),
    "java": (
        "java",
        [
            "public class Cell_{i} {",
            "    public int get_{i}(int k) {",
            "        while (k > 0) { k--; }",
            "    }",
            "}",
        ],
        [
            ("Cell_{i}", "class", 1, 5, "public class Cell_{i} {"),
            ("get_{i}", "function", 2, 4, "public int get_{i}(int k) {"),
        ],
    ),
    "c": (
        "c",
        ["struct Slot_{i} {", "    int a;", "};", "int fold_{i}(int z) {", "    return z;", "}"],
        [
            ("Slot_{i}", "class", 1, 3, "struct Slot_{i} {"),
            ("fold_{i}", "function", 4, 6, "int fold_{i}(int z) {"),
        ],
    ),
    "cpp": (
        "cpp",
        ["class Ring_{i} {", "};", "static char* spin_{i}(char *s) {", "    s[0] = '}';", "}"],
        [
            ("Ring_{i}", "class", 1, 2, "class Ring_{i} {"),
            ("spin_{i}", "function", 3, 5, "static char* spin_{i}(char *s) {"),
        ],
    ),
}
LANGUAGES = list(BLOCKS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A sample table. The samples are files of one row group, so one task would read and work on each;
    ``spark.annalist.spread`` asks for their rows in that many partitions, at any size."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    spread = spark.conf.get("spark.annalist.spread", None)
    return rows.repartition(int(spread)) if spread else rows


def _filled(template: str, i: Column) -> Column:
    pieces = [F.lit(piece) for piece in template.split("{i}")]
    column = pieces[0]
    for piece in pieces[1:]:
        column = F.concat(column, i.cast("string"), piece)
    return column


def _block(language: str, i: Column) -> Column:
    return F.concat_ws("\n", *[_filled(line, i) for line in BLOCKS[language][1]])


def _repeated(language: str, count: Column) -> Column:
    """Blocks 1..count of the language, as one text."""
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _block(language, i)), "\n")


def head_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file per part in one of eight languages, and the project documents."""
    key = F.col("p_partkey")
    language, suffix, content = F.lit(""), F.lit(""), F.lit("")
    for number, name in enumerate(LANGUAGES):
        mine = key % len(LANGUAGES) == number
        suffix = F.when(mine, BLOCKS[name][0]).otherwise(suffix)
        content = F.when(mine, _repeated(name, F.col("p_size"))).otherwise(content)
    path = F.concat(
        F.lower("p_type"), F.lit("/part_"), key.cast("string"), F.lit("."), suffix
    )
    parts = read(spark, sf_dir, "part").repartition(_width(spark), "p_partkey")
    return parts.select("p_partkey", "p_size", path.alias("file_path"), content.alias("content"))


# ---- two sides of a source file per order and part -----------------------------

# What happens to the file, by line number. Block count is n.
#   1 created, 2 removed, 3 first body edited, 4 last block dropped, 5 first block renamed,
#   6 a line put in front, 7 a block appended.


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, part): what happened (ln), a quantity (q), and n blocks."""
    # spread before they are grouped: where the grouping makes the same partitions, a later repartition is dropped
    # and adaptive execution merges those of the grouping by their bytes
    lines = spread(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    items = lines.groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_linenumber").alias("ln"), F.sum("l_quantity").cast("int").alias("q")
    )
    parts = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_type",
        (F.col("p_size") % 3 + 2).cast("int").alias("n"),
    )
    return items.join(parts, "l_partkey").repartition(_width(spark), "l_orderkey", "l_partkey")


def _width(spark: SparkSession) -> int:
    """Partitions for small rows that large texts are built from: by count, not by bytes."""
    return max(
        4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """*rows* in that many partitions, by *key*."""
    return rows.repartition(_width(rows.sparkSession), *key)


def _is_python() -> Column:
    return F.col("l_partkey") % 2 == 0


def source_path() -> Column:
    return F.concat(
        F.lower("p_type"), F.lit("/part_"), F.col("l_partkey").cast("string"),
        F.when(_is_python(), ".py").otherwise(".rs"),
    )


def _text(count: Column) -> Column:
    return F.when(_is_python(), _repeated("python", count)).otherwise(_repeated("rust", count))


def before_content() -> Column:
    return F.when(F.col("ln") == 1, "").otherwise(_text(F.col("n")))


def after_content() -> Column:
    n, ln = F.col("n"), F.col("ln")
    whole = _text(n)
    front = F.when(_is_python(), F.lit("# moved\n")).otherwise(F.lit("// moved\n"))
    edited = F.when(_is_python(), F.regexp_replace(whole, "# note 1(?!\\d)", "# changed 1")).otherwise(
        F.regexp_replace(whole, r"^([^\n]*)\n    x: f64", "$1\n    x: f32")
    )
    renamed = F.when(_is_python(), F.replace(whole, F.lit("make_1("), F.lit("made_1("))).otherwise(
        F.replace(whole, F.lit("go_1("), F.lit("gone_1("))
    )
    return (
        F.when(ln == 2, "")
        .when(ln == 3, edited)
        .when(ln == 4, _text(n - 1))
        .when(ln == 5, renamed)
        .when(ln == 6, F.concat(front, whole))
        .when(ln == 7, _text(n + 1))
        .otherwise(whole)
    )


# ---- configuration files per user ----------------------------------------------


def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event writes a new version of its user's file, as JSON, YAML or TOML."""
    user = F.col("user_id")

    def text(props: Column) -> Column:
        number = F.get_json_object(props, "$.k")
        json = F.concat(
            F.lit('{"user": {"last": '), props,
            F.lit('}, "tags": [1, "a"], "flag": true, "none": null}'),
        )
        yaml = F.concat(F.lit("user:\n  last:\n    k: "), number, F.lit("\nflag: true\n"))
        toml = F.concat(F.lit("flag = true\n[user.last]\nk = "), number, F.lit("\n"))
        return F.when(user % 3 == 0, json).when(user % 3 == 1, yaml).otherwise(toml)

    suffix = F.when(user % 3 == 0, ".json").when(user % 3 == 1, ".yaml").otherwise(".toml")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return (
        read(spark, sf_dir, "events")
        .withColumn("last", F.lag("props").over(by_time))
        .select("event_id", "user_id", "props", "last")
        .repartition(_width(spark), "event_id")
        .withColumn("text", text(F.col("props")))
        .withColumn("before", text(F.col("last")))
        .select(
            F.md5(F.col("event_id").cast("string")).alias("commit_hash"),
            F.concat(F.lit("conf/user_"), user.cast("string"), suffix).alias("file_path"),
            F.coalesce("before", F.lit("")).alias("before_content"),
            F.col("text").alias("after_content"),
        )
    )


# ---- dependency manifests per order and part -----------------------------------


def _manifest(kind: int, entries: list[tuple[Column, Column]]) -> Column:
    """A manifest of one of five formats that lists (package, version) pairs."""
    if kind == 0:  # requirements.txt
        lines = [F.concat(p, F.lit("=="), v, F.lit("  # pinned")) for p, v in entries]
        return F.concat_ws("\n", F.lit("# tools"), F.lit("-r base.txt"), *lines)
    if kind == 1:  # package.json
        pairs = [F.concat(F.lit('"'), p, F.lit('": "'), v, F.lit('"')) for p, v in entries]
        return F.concat(F.lit('{"name": "x", "dependencies": {'), F.concat_ws(", ", *pairs), F.lit("}}"))
    if kind == 2:  # pyproject.toml
        items = [F.concat(F.lit('"'), p, F.lit(">="), v, F.lit('"')) for p, v in entries]
        return F.concat(F.lit("[project]\ndependencies = ["), F.concat_ws(", ", *items), F.lit("]\n"))
    if kind == 3:  # Cargo.toml
        first, *rest = entries
        lines = [F.concat(first[0], F.lit(' = { version = "'), first[1], F.lit('" }'))]
        lines += [F.concat(p, F.lit(' = "'), v, F.lit('"')) for p, v in rest]
        return F.concat(F.lit("[dependencies]\n"), F.concat_ws("\n", *lines))
    lines = [F.concat(F.lit("\t"), p, F.lit(" v"), v, F.lit(" // indirect")) for p, v in entries]
    return F.concat(F.lit("module x\n\nrequire (\n"), F.concat_ws("\n", *lines), F.lit("\n)\n"))


# Manifest names by part key modulo 5.
MANIFESTS = ["requirements.txt", "package.json", "pyproject.toml", "Cargo.toml", "go.mod"]


def manifest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before: core, and lib at version ln. After: lib at another version, extra by quantity."""
    rows = versions(spark, sf_dir)
    kind = F.col("l_partkey") % len(MANIFESTS)
    ln, q = F.col("ln"), F.col("q")
    core = (F.lit("core"), F.lit("1.0"))
    old_lib = (F.lit("lib"), F.concat(F.lit("2."), ln.cast("string")))
    new_lib = (F.lit("lib"), F.concat(F.lit("2."), (ln + q % 2).cast("string")))
    extra = (F.concat(F.lit("extra"), (q % 5).cast("string")), F.lit("0.1"))
    before, after, name = F.lit(""), F.lit(""), F.lit("")
    for number, manifest in enumerate(MANIFESTS):
        before = F.when(kind == number, _manifest(number, [core, old_lib])).otherwise(before)
        after = F.when(kind == number, _manifest(number, [new_lib, extra])).otherwise(after)
        name = F.when(kind == number, manifest).otherwise(name)
    return rows.select(
        F.md5(F.col("l_orderkey").cast("string")).alias("commit_hash"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string"), F.lit("/"), name).alias("file_path"),
        before.alias("before_content"),
        after.alias("after_content"),
    )


# ---- what must be found in them, as SQL ----------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _block_values() -> str:
    rows = []
    for number, (name, (suffix, lines, found)) in enumerate(BLOCKS.items()):
        for definition, kind, first, last, signature in found:
            rows.append(
                f"({number}, '{name}', '{suffix}', {len(lines)}, {_quoted(definition)}, '{kind}',"
                f" {first}, {last}, {_quoted(signature)})"
            )
    return ", ".join(rows)


def _block_sources() -> str:
    rows = []
    for number, (name, (suffix, lines, found)) in enumerate(BLOCKS.items()):
        for definition, kind, first, last, _ in found:
            source = _quoted("\n".join(lines[first - 1 : last]))
            rows.append(
                f"({number}, '{name}', '{suffix}', {len(lines)}, {_quoted(definition)}, '{kind}',"
                f" {first}, {last}, {source})"
            )
    return ", ".join(rows)


SQL = {
    "h_block_sources": f"""
        SELECT * FROM (VALUES {_block_sources()})
          v(number, language, suffix, size, name, kind, first, last, source)""",
    "h_blocks": f"""
        SELECT * FROM (VALUES {_block_values()})
          v(number, language, suffix, size, name, kind, first, last, signature)""",
    "h_versions": """
        SELECT l_orderkey, l_partkey, lower(p_type) AS folder, min(l_linenumber) AS ln,
               CAST(sum(l_quantity) AS INTEGER) AS q, any_value(p_size) % 3 + 2 AS n,
               md5(CAST(l_orderkey AS VARCHAR)) AS commit_hash
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey, p_type""",
}

"""Bindings of the domain to the star-schema tables: each builds its rows from a given table, so it grows with that."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import spread

# Programs written for this purpose; ~K~ and ~S~ stand for a part's key and size. Three to a language, in the order of LANGUAGE_NAMES.
TEMPLATES = (
    "import math\n\n# area ~K~\ndef area_~K~(width, height):\n    total = width * height + ~S~\n    if total > 100:\n        return total ** 2\n    elif total == 0:\n        return None\n    return math.sqrt(total)\n",
    "def tally_~K~(lines, most):\n    '''Counts words\n    up to ~S~.'''\n    seen, longest = {}, 0\n    for line in lines:\n        for word in line.split():\n            seen[word] = seen.get(word, 0) + 1\n            longest = max(longest, len(word))\n    if longest // 2 >= most or not seen:\n        return -~S~\n    return [w for w in seen if seen[w] != 1]\n",
    "class Box~K~:\n    def __init__(self, size=~S~, name=\"b\\\"~K~\"):\n        self.size = size\n        self.name = name\n\n    def grow(self, by):\n        for step in range(by):\n            self.size += step * 0.5e1\n        return self.size\n",
    "// sum ~K~\nconst total~K~ = (list) => {\n  let sum = 0;\n  for (const item of list) {\n    if (item !== null && item >= ~S~) {\n      sum += item ** 2;\n    }\n  }\n  return `sum ${sum}\nend`;\n};\n",
    "function pick_~K~(rows, at) {\n  /* picks\n     one */\n  var row = rows[at] ?? ~S~;\n  if (row?.name === 'x') { return 0xFFn; }\n  while (at > 0) {\n    at -= 1;\n  }\n  return row;\n}\nconsole.log(pick_~K~([1, 2.5e3], 0));\n",
    "export default class Timer~K~ extends Base {\n  async wait(ms) {\n    try {\n      await this.sleep(ms + ~S~);\n    } catch (err) {\n      throw new Error(\"t\\\"~K~\");\n    } finally {\n      delete this.clock;\n    }\n  }\n}\n",
    "import java.util.List;\n\npublic class Counter~K~ {\n    @Override\n    public int count(List<String> names) {\n        int found = 0;\n        for (String name : names) {\n            if (name.length() > ~S~) {\n                found++;\n            }\n        }\n        return found;\n    }\n}\n",
    "package shop;\npublic class Price~K~ {\n    private final double base = ~S~.5f;\n    public static void main(String[] args) {\n        long id = 0xFFL;\n        do {\n            id--;\n        } while (id > 0 || args == null);\n        System.out.println(\"id \" + id);\n    }\n}\n",
    "public class Queue~K~ extends Base implements Runnable {\n    public void run() {\n        try {\n            items.forEach(x -> use(x, ~S~));\n        } catch (Exception e) {\n            throw e;\n        }\n        // done\n    }\n}\n",
    "#include <iostream>\n#include <vector>\nusing namespace std;\n\nint sum~K~(const vector<int>& xs) {\n    int total = 0;\n    for (size_t i = 0; i < xs.size(); ++i) {\n        total += xs[i] * ~S~;\n    }\n    cout << \"total: \" << total << endl;\n    return total;\n}\n",
    "template <typename T>\nclass Stack~K~ {\npublic:\n    void push(T value) { data[top++] = value; }\n    T* peek() { return top > 0 ? &data[top - 1] : nullptr; }\nprivate:\n    T data[~S~];\n    int top = 0;\n};\n",
    "#include <string>\nnamespace app~K~ {\n    struct Node { Node* next; std::string name; };\n    bool has(Node* n, unsigned long id) {\n        while (n != NULL) {\n            if (n->name == \"a\" && id >= ~S~u) return true;\n            n = n->next;\n        }\n        return false;\n    }\n}\n",
    "#include <stdio.h>\n#define LIMIT ~S~\n\nint main(void) {\n    int i, total~K~ = 0;\n    for (i = 0; i < LIMIT; i++) {\n        total~K~ += i % 3;\n    }\n    printf(\"%d\\n\", total~K~);\n    return 0;\n}\n",
    "struct Point~K~ { int x; int y; };\n\nstatic double dist(struct Point~K~ *p) {\n    /* plain */\n    if (p == NULL) {\n        return -1.0;\n    }\n    return p->x * p->x + p->y * ~S~;\n}\nint main() { printf(\"%f\", dist(NULL)); }\n",
    "#include <stdlib.h>\ntypedef enum { RED, GREEN } Color~K~;\nunsigned size_of(char *s) {\n    switch (s[0]) {\n        case 'a': return sizeof(int);\n        default: break;\n    }\n    return ~S~UL | 0x1f;\n}\n",
    "using System;\n\nclass Program~K~ {\n    static void Main() {\n        foreach (var item in items) {\n            if (item.Size >= ~S~m) {\n                Console.WriteLine($\"item {item}\");\n            }\n        }\n    }\n}\n",
    "namespace Shop.Core {\n    internal interface IStore~K~ { string Name(int id); }\n    public class Store : Base {\n        private decimal price = ~S~.5m;\n        public bool Has(object x) => x is string && x != null ?? false;\n    }\n}\n",
    "using System.Linq;\npublic class Report~K~ {\n    public async Task Run(string path = @\"c:\\dir\") {\n        try { await Load(path, ~S~); }\n        catch (Exception e) { throw; }\n        finally { base.Close(); }\n    }\n}\n",
)
#: Names of the language as uploaders write them, by part key modulo 12; the file name has the extension.
LANGUAGE_NAMES = ("python", "javascript", "java", "cpp", "c", "csharp", "auto", "js", None, "c++", "auto", "cs")
FILE_EXTENSIONS = ("py", "js", "java", "cpp", "c", "cs")


def _filled(template: str) -> Column:
    values = {"K": F.col("p_partkey").cast("string"), "S": F.col("p_size").cast("string")}
    pieces = re.split(r"~([KS])~", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def _chosen(index: Column, values: list[Column]) -> Column:
    return reduce(lambda chain, pair: chain.when(index == pair[0], pair[1]), enumerate(values[1:], 1), F.when(index == 0, values[0]))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def programs_of(part: DataFrame) -> DataFrame:
    """A program for each row of part, a table or a stream: assignment_id (brand and language), submission_id, student_id, student_name, status, submitted_at, language, file_name, code."""
    key = F.col("p_partkey")
    kind = key % 6
    template = kind * 3 + F.floor(key / 6) % 3
    code = _chosen(template, [_filled(t) for t in TEMPLATES])
    # a part is a few bytes and a program's tokens are many: a table of one file is dealt over all tasks
    return spread(part.select("p_partkey", "p_brand", "p_size", "p_name"), "p_partkey").select(
        F.concat("p_brand", F.lit("/"), _chosen(kind, [F.lit(x) for x in FILE_EXTENSIONS])).alias("assignment_id"),
        key.alias("submission_id"),
        F.concat(F.lit("S"), F.col("p_size")).alias("student_id"),
        F.col("p_name").alias("student_name"),
        F.when(key % 13 == 0, "failed").otherwise("fingerprinted").alias("status"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, p_partkey * 60 + p_size * 7)").alias("submitted_at"),
        _chosen(key % 12, [F.lit(x) for x in LANGUAGE_NAMES]).alias("language"),
        F.concat(F.lit("w"), key, F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("."), _chosen(kind, [F.lit(x) for x in FILE_EXTENSIONS])))).alias("file_name"),
        code.alias("code"),
    )


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """programs_of() the part table, with version."""
    from pyspark.sql.window import Window

    rows = programs_of(read_table(spark, sf_dir, "part"))
    arrival = Window.partitionBy("assignment_id", "student_id").orderBy("submitted_at", "submission_id")
    return rows.withColumn("version", F.row_number().over(arrival))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as submissions of their source: assignment_id, submission_id, text."""
    return read_table(spark, sf_dir, "documents").select(F.col("source").alias("assignment_id"), F.col("doc_id").alias("submission_id"), "text")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as submission attempts: assignment_id, submission_id, student_id, status, submitted_at, value."""
    key = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("assignment_id"),
        key.alias("submission_id"),
        F.concat(F.lit("S"), F.col("user_id")).alias("student_id"),
        F.when(key % 11 == 0, "failed").when(key % 7 == 0, "queued").otherwise("fingerprinted").alias("status"),
        F.col("ts").alias("submitted_at"),
        "value",
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assignments: assignment_id, owner_id, title, created_at, deadline, analysis_status, threshold, language_allowed."""
    key = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        key.alias("assignment_id"),
        F.col("o_custkey").alias("owner_id"),
        F.concat("o_orderpriority", F.lit(" task "), key).alias("title"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 30, cast(o_orderkey % 24 as int))")).alias("deadline"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "queued").otherwise("idle").alias("analysis_status"),
        ((key % 10) / 10).alias("threshold"),
        _chosen(key % 4, [F.lit(x) for x in ("python", "javascript", "java", "auto")]).alias("language_allowed"),
    )


def handins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as submissions to those assignments: assignment_id, submission_id, student_id, file_name, submitted_at."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("assignment_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("submission_id"),
        F.col("l_suppkey").alias("student_id"),
        F.concat(F.lit("f"), F.col("l_partkey"), F.lit("."), _chosen(F.col("l_partkey") % 5, [F.lit(x) for x in ("py", "js", "JAVA", "txt", "md")])).alias("file_name"),
        F.col("l_shipdate").alias("submitted_at"),
        F.col("l_linestatus").alias("line_status"),
    )

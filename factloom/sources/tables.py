"""Facts from the star-schema tables: a design graph of regions, nations, suppliers and parts.

Regions are modules, nations packages (real where a supplier of theirs is rich enough), suppliers
files, parts symbols in the file of their least supplier, trade between nations imports, trade
between regions dependencies, lines of orders decisions, poor customers loader messages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import classify_loading

RICH, POOR = 6000, -900
OUTSIDE = "imported_package_outside_known_workspace"
ABSENT = "required_module_not_present_in_workspace"
PART_KINDS = ("method", "struct", "interface", "type", "field", "function")


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def packages(self) -> DataFrame:
        """n_nationkey, module, pkg, real."""
        rich = self.read("supplier").where(F.col("s_acctbal") > RICH).select(F.col("s_nationkey").alias("rich")).distinct()
        n = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(rich, F.col("n_nationkey") == F.col("rich"), "left")
        return n.select("n_nationkey", F.col("r_name").alias("module"), F.concat_ws("/", "r_name", "n_name").alias("pkg"), F.col("rich").isNotNull().alias("real"))

    def symbols(self) -> DataFrame:
        """Parts with id, kind, name, file and package."""
        first = self.read("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey"))
        p = self.read("part").join(first, F.col("p_partkey") == F.col("l_partkey")).join(self.read("supplier"), "s_suppkey").join(self.packages(), F.col("s_nationkey") == F.col("n_nationkey"))
        words = F.initcap("p_name")
        camel = F.concat(F.lower(F.left(words, F.lit(1))), F.substring(F.replace(words, F.lit(" "), F.lit("")), 2, 200), F.initcap(F.lower("p_type")))
        name = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("HTTP"), F.initcap(F.left("p_name", F.lit(1))), F.substring(camel, 2, 200))).otherwise(camel)
        kind = F.element_at(F.array(*map(F.lit, PART_KINDS)), (F.col("p_size") % 6 + 1).cast("int"))
        key = F.col("p_partkey").cast("string")
        line = F.col("p_partkey") % 500 + 1
        return p.select(
            F.concat(kind, F.lit(":"), "pkg", F.lit("."), name, F.lit("_"), key).alias("id"), kind.alias("kind"), name.alias("name"), "pkg", "module", "p_partkey",
            F.concat("pkg", F.lit("/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".go")).alias("file"),
            F.concat(line.cast("string"), F.lit(":1-"), (line + F.col("p_size")).cast("string"), F.lit(":2")).alias("lineRange"),
        )

    def nodes(self) -> DataFrame:
        none = F.lit("")
        row = lambda i, k, n, t, s, r, f, lr, p, m: [
            i.alias("id"), k.alias("kind"), n.alias("name"), t.alias("trustLevel"), s.alias("synthetic"), F.lit("fresh").alias("freshness"), r.alias("reason"),
            f.alias("sourceFile"), lr.alias("lineRange"), p.alias("packagePath"), m.alias("modulePath"),
        ]
        seen, no = F.lit("syntax_observed"), F.lit(False)
        name = F.col("r_name")
        modules = self.read("region").select(*row(M.module_id(name), F.lit("module"), name, seen, no, none, F.concat(name, F.lit("/go.mod")), none, none, name))
        p = self.packages()
        trust = F.element_at(F.array(*map(F.lit, reversed(M.TRUST))), (F.col("n_nationkey") % 3 + 1).cast("int"))
        pkg, mod = F.col("pkg"), F.col("module")
        real = p.where("real").select(*row(M.package_id(pkg), F.lit("package"), pkg, trust, no, none, F.concat(pkg, F.lit("/doc.go")), F.lit("1:1-3:1"), pkg, mod))
        ghost = p.where("not real").select(*row(F.concat(F.lit("placeholder:package:"), pkg), F.lit("placeholder"), pkg, seen, F.lit(True), F.lit(OUTSIDE), none, none, pkg, none))
        s = self.read("supplier").join(p, F.col("s_nationkey") == F.col("n_nationkey"))
        file = F.concat("pkg", F.lit("/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".go"))
        files = s.select(*row(F.concat(F.lit("file:"), file), F.lit("file"), file, seen, no, none, file, F.lit("1:1-600:1"), pkg, mod))
        y = self.symbols()
        symbols = y.select(*row(F.col("id"), F.col("kind"), F.col("name"), seen, no, none, F.col("file"), F.col("lineRange"), pkg, mod))
        return modules.union(real).union(ghost).union(files).union(symbols)

    def trade(self) -> DataFrame:
        """Distinct (from, to) nations of suppliers and customers."""
        lines = self.read("lineitem").select("l_orderkey", "l_suppkey")
        pairs = lines.join(self.read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        pairs = pairs.join(self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        pairs = pairs.join(self.read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return pairs.select("s_nationkey", "c_nationkey").distinct()

    def edges(self) -> DataFrame:
        """imports, depends_on, contains and declares edges."""
        row = lambda k, a, b, done, r, f: [
            M.edge_id(F.lit(k), a, b).alias("id"), a.alias("from"), b.alias("to"), F.lit(k).alias("kind"), F.lit("syntax_observed").alias("trustLevel"), F.lit(False).alias("synthetic"),
            done.alias("complete"), r.alias("reason"), f.alias("sourceFile"), F.lit("1:1-1:9").alias("lineRange"),
        ]
        p = self.packages()
        a = p.select(F.col("n_nationkey").alias("s_nationkey"), F.col("pkg").alias("ap"), F.col("module").alias("am"), F.col("real").alias("ar"))
        b = p.select(F.col("n_nationkey").alias("c_nationkey"), F.col("pkg").alias("bp"), F.col("module").alias("bm"), F.col("real").alias("br"))
        pairs = self.trade().join(a, "s_nationkey").join(b, "c_nationkey")
        to = F.concat(F.when(F.col("br"), "package:").otherwise("placeholder:package:"), "bp")
        imports = pairs.where("ar").select(*row("imports", M.package_id("ap"), to, F.col("br"), F.when(F.col("br"), "").otherwise(OUTSIDE), F.concat("ap", F.lit("/import.go"))))
        m = pairs.where("am <> bm").select("am", "bm").distinct()
        gone = F.col("bm") == "MIDDLE EAST"
        target = F.concat(F.when(gone, "placeholder:module:").otherwise("module:"), "bm")
        needs = m.select(*row("depends_on", M.module_id("am"), target, ~gone, F.when(gone, ABSENT).otherwise(""), F.concat("am", F.lit("/go.mod"))))
        s = self.read("supplier").join(p.where("real"), F.col("s_nationkey") == F.col("n_nationkey"))
        file = F.concat("pkg", F.lit("/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".go"))
        yes, none = F.lit(True), F.lit("")
        holds = s.select(*row("contains", M.package_id("pkg"), F.concat(F.lit("file:"), file), yes, none, file))
        y = self.symbols()
        declares = y.select(*row("declares", F.concat(F.lit("file:"), "file"), F.col("id"), yes, none, F.col("file")))
        return imports.union(needs).union(holds).union(declares)

    def diagnostics(self) -> DataFrame:
        c = self.read("customer").where(F.col("c_acctbal") < POOR).join(self.packages(), F.col("c_nationkey") == F.col("n_nationkey"))
        texts = ("import cycle not allowed: ", "no required module provides package ", "missing go.sum entry for ", "syntax error near ")
        reason = F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col("c_custkey") % 4 + 1).cast("int")), "c_name")
        status = classify_loading(reason)
        return c.select(
            F.when(status == "import_cycle", "error").otherwise("warning").alias("level"), F.concat(F.lit("go/packages:"), "pkg").alias("source"), reason.alias("reason"), F.lit("package_loading").alias("stage"),
            F.lit("indexer.package_loading").alias("analyzerId"), status.alias("status"), F.lit("").alias("sourceFile"), F.lit("").alias("lineRange"),
        )

    def decisions(self) -> DataFrame:
        """(sourceFile, functionId, kind): what the lines of a part's orders stand for."""
        f = self.symbols().where("kind in ('function', 'method')").select("p_partkey", F.col("id").alias("functionId"), F.col("file").alias("sourceFile"))
        one = lambda test, kind: F.when(test, F.lit(kind))
        kinds = F.array(
            one(F.col("l_returnflag") == "R", "if"), one(F.col("l_discount") > 0.05, "case"), one(F.col("l_linestatus") == "O", "boolean"),
            one(F.col("l_tax") > 0.06, "select_default"), one(F.col("l_quantity") > 45, "goto"), one(F.col("l_linenumber") == 1, "go"), one(F.col("l_linenumber") == 2, "defer"),
        )
        return self.read("lineitem").join(f, F.col("l_partkey") == F.col("p_partkey")).select("sourceFile", "functionId", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))

    def source_records(self) -> DataFrame:
        r, one = self.read("region"), self.spark.range(1)
        row = lambda k, p, r: [F.concat_ws(":", F.lit("source_record"), F.lit(k), p).alias("id"), F.lit(k).alias("kind"), p.alias("path"), r.alias("reason")]
        n = F.col("r_name")
        out = one.select(*row("project_root", F.lit("."), F.lit("entry_module"))).union(one.select(*row("workspace_root", F.lit("."), F.lit("workspace"))))
        out = out.union(r.select(*row("go_mod", F.concat(n, F.lit("/go.mod")), F.lit("workspace_walk")))).union(r.where("r_regionkey < 3").select(*row("go_mod", F.concat(n, F.lit("/nested/go.mod")), F.lit("workspace_walk"))))
        return out.union(r.select(*row("module_discovery", n, F.lit("workspace_walk, replace,,go_work"))))

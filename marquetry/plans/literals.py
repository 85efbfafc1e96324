"""Small literal tables, as DataFrames and as SQL ``VALUES``, for queries over relations that
the driver's tables do not hold: control flow, source lines, class relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Literal:
    """``name``, a schema and rows."""

    name: str
    schema: str
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        """A common table expression of the same rows."""
        kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INT", "boolean": "BOOLEAN", "double": "DOUBLE"}
        columns = [c.strip().split(" ") for c in self.schema.split(",")]
        cells = [", ".join(f"{_cell(v)}::{kinds[k]}" for v, (_, k) in zip(r, columns, strict=True)) for r in self.rows]
        names = ", ".join(f'"{n}"' for n, _ in columns)
        return f"{self.name}({names}) AS (VALUES {', '.join(f'({c})' for c in cells)})"


def _cell(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).upper() if isinstance(value, bool) else str(value)


#: A loop with a branch in it, an early return, and a straight line. Block 0 enters, 1 exits.
CFG = Literal("cfg", "func string, src int, dst int", (
    ("loop", 0, 2), ("loop", 2, 3), ("loop", 2, 6), ("loop", 3, 4), ("loop", 3, 5), ("loop", 4, 2), ("loop", 5, 2), ("loop", 6, 1),
    ("early", 0, 2), ("early", 0, 3), ("early", 2, 1), ("early", 3, 4), ("early", 4, 1), ("line", 0, 1),
))
DEFS = Literal("defs", "func string, block int, stmt int, var string", (
    ("loop", 0, 1, "n"), ("loop", 0, 3, "total"), ("loop", 4, 21, "total"), ("loop", 5, 31, "total"), ("loop", 5, 33, "last"), ("loop", 2, 11, "i"),
    ("early", 0, 1, "x"), ("early", 2, 11, "x"), ("early", 3, 21, "y"), ("early", 4, 31, "y"),
))
USES = Literal("uses", "func string, block int, stmt int, var string", (
    ("loop", 2, 10, "n"), ("loop", 3, 15, "i"), ("loop", 4, 20, "total"), ("loop", 4, 20, "i"), ("loop", 5, 30, "total"), ("loop", 5, 34, "last"), ("loop", 6, 40, "total"),
    ("early", 0, 2, "x"), ("early", 2, 12, "x"), ("early", 3, 20, "x"), ("early", 4, 32, "y"),
))
#: Call sites: caller, its block, callee, the callee's entry and exit blocks.
SITES = Literal("sites", "caller string, block int, callee string, entry int, exit int", (("loop", 4, "early", 0, 4), ("loop", 5, "line", 0, 1)))

#: Source lines of three small files, one statement a line.
SOURCES = {
    ("app/jobs.py", "python"): (
        "# Phase 2: add the new pipeline step\n# Step 3 of 5\ndef step_2_run(x):\n    pass\n\ndef load_final():\n    raise NotImplementedError\n\n"
        "def ok(n):\n    print('DEBUG n')\n    return n  # TODO later\n\n\"\"\"\n# Phase 9: build nothing, this is text\n\"\"\"\n"
    ),
    ("web/page.js", "javascript"): "// Welcome to your CDK project\nfunction week1_report() {\n  console.log('>>> here');\n  throw new Error('not implemented');\n}\n",
    ("tests/test_jobs.py", "python"): "# Phase 1: add tests\ndef test_ok():\n    ...\n",
}

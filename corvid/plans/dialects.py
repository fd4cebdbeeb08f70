"""Small sources in every language with an outline, written once for each nation, and the symbols that they hold.

``SOURCES``: suffix of the file, its text (``@`` stands for the nation's key), and its symbols by hand: name, kind, first
line, last line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Symbol = tuple[str, str, int, int]

SOURCES: tuple[tuple[str, str, tuple[Symbol, ...]], ...] = (
    ("zig", 'const std = @import("std");\n\npub const Shape_@ = struct {\n    w: u32,\n};\n\npub fn area_@(x: u32) u32 {\n    // a { in a comment\n    return x;\n}\n', (("std", "import", 1, 1), ("Shape_@", "struct_def", 3, 5), ("area_@", "function", 7, 10))),
    ("ts", "import { a } from './lib_@';\n\nexport interface Shape_@ {\n  w: number;\n}\n\nexport function area_@(x: number): number {\n  return x;\n}\n\nexport class Box_@ {\n}\n", (("./lib_@", "import", 1, 1), ("Shape_@", "interface_def", 3, 5), ("area_@", "function", 7, 9), ("Box_@", "class_def", 11, 12))),
    ("js", "const lib = require('lib_@');\n\nasync function area_@(x) {\n  return '}';\n}\n\nclass Box_@ {\n}\n", (("lib_@", "import", 1, 1), ("area_@", "function", 3, 5), ("Box_@", "class_def", 7, 8))),
    ("c", '#include "lib_@.h"\n#define MOST_@ 3\n\nstruct shape_@ {\n    int w;\n};\n', (("lib_@.h", "import", 1, 1), ("MOST_@", "macro_def", 2, 2), ("shape_@", "struct_def", 4, 6))),
    ("cpp", "#include <lib_@>\n\nenum class Hue_@ {\n    red,\n};\n\nclass Box_@ {\n};\n", (("lib_@", "import", 1, 1), ("Hue_@", "enum_def", 3, 5), ("Box_@", "class_def", 7, 8))),
    ("rs", "pub struct Shape_@ {\n    w: u32,\n}\n\npub fn area_@(x: u32) -> u32 {\n    x\n}\n\n#[test]\nfn checks_@() {\n    assert!(true);\n}\n", (("Shape_@", "struct_def", 1, 3), ("area_@", "function", 5, 7), ("checks_@", "test_decl", 10, 12))),
    ("go", 'package p\n\nimport (\n\t"lib_@"\n)\n\ntype Shape_@ struct {\n\tw int\n}\n\nfunc (s Shape_@) Area_@(x int) int {\n\tif x > 0 {\n\t\treturn x\n\t}\n\treturn 0\n}\n', (("lib_@", "import", 4, 4), ("Shape_@", "struct_def", 7, 9), ("Area_@", "function", 11, 16))),
    ("php", "<?php\n\nabstract class Box_@\n{\n    public function area_@($x)\n    {\n        return $x;\n    }\n}\n", (("Box_@", "class_def", 3, 9), ("area_@", "function", 5, 8))),
    ("rb", "require 'lib_@'\n\nclass Box_@\n  def area_@(x)\n    x\n  end\nend\n", (("lib_@", "import", 1, 1), ("Box_@", "struct_def", 3, 7), ("area_@", "function", 4, 6))),
    ("tf", 'variable "size_@" {\n  default = 1\n}\n\nresource "kind" "box_@" {\n  size = 1\n}\n', (("size_@", "variable", 1, 1), ("box_@", "struct_def", 5, 7))),
    ("r", "library(lib_@)\n\narea_@ <- function(x) {\n  x\n}\n", (("lib_@", "import", 1, 1), ("area_@", "function", 3, 5))),
    ("dart", "import 'lib_@.dart';\n\nabstract class Box_@ {\n}\n\nenum Hue_@ { red }\n", (("lib_@.dart", "import", 1, 1), ("Box_@", "class_def", 3, 4), ("Hue_@", "enum_def", 6, 6))),
    ("java", "import lib.of_@;\n\npublic final class Box_@ {\n    public int area_@(int x) {\n        return x;\n    }\n}\n", (("lib.of_@", "import", 1, 1), ("Box_@", "class_def", 3, 7), ("area_@", "method", 4, 6))),
    ("kt", "import lib.of_@\n\ndata class Box_@(val w: Int) {\n}\n\nfun area_@(x: Int): Int {\n    return x\n}\n", (("lib.of_@", "import", 1, 1), ("Box_@", "class_def", 3, 4), ("area_@", "function", 6, 8))),
    ("swift", "import Lib_@\n\nstruct Shape_@ {\n}\n\nprotocol Sized_@ {\n}\n\nfunc area_@(x: Int) -> Int {\n    return x\n}\n", (("Lib_@", "import", 1, 1), ("Shape_@", "struct_def", 3, 4), ("Sized_@", "interface_def", 6, 7), ("area_@", "function", 9, 11))),
    ("vue", "<script>\nfunction area_@(x) {\n  return x\n}\n</script>\n", (("area_@", "function", 2, 4),)),
    ("sh", "source lib_@.sh\nSIZE_@=3\n\narea_@() {\n  echo 1\n}\n", (("lib_@.sh", "import", 1, 1), ("SIZE_@", "variable", 2, 2), ("area_@", "function", 4, 6))),
    ("css", ".box_@ {\n  width: 1px;\n}\n", ((".box_@", "class_def", 1, 3),)),
    ("sql", "CREATE TABLE IF NOT EXISTS shapes_@ (w int);\n\ncreate or replace view wide_@ as select 1;\n", (("shapes_@", "struct_def", 1, 1), ("wide_@", "struct_def", 3, 3))),
    ("proto", 'import "lib_@.proto";\n\nmessage Shape_@ {\n  int32 w = 1;\n}\n\nenum Hue_@ {\n  RED = 0;\n}\n', (("lib_@.proto", "import", 1, 1), ("Shape_@", "struct_def", 3, 5), ("Hue_@", "enum_def", 7, 9))),
    ("f90", "module shapes_@\nuse lib_@\n", (("shapes_@", "class_def", 1, 1), ("lib_@", "import", 2, 2))),
    ("ll", "%shape_@ = type { i32 }\n\ndefine i32 @area_@(i32 %x) {\n  ret i32 %x\n}\n", (("shape_@", "type_alias", 1, 1), ("area_@", "function", 3, 5))),
    ("mlir", "module @shapes_@ {\n  func.func @area_@(%x: i32) {\n    return\n  }\n}\n", (("shapes_@", "class_def", 1, 5), ("area_@", "function", 2, 4))),
    ("td", 'include "lib_@.td"\n\nclass Box_@ {\n}\n', (("lib_@.td", "import", 1, 1), ("Box_@", "class_def", 3, 4))),
    ("res", "open Lib_@\n\nmodule Box_@ = {\n}\n", (("Lib_@", "import", 1, 1), ("Box_@", "struct_def", 3, 4))),
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a file for each nation and language."""
    key = F.col("n_nationkey").cast("string")
    each = F.array(*[F.struct(F.lit(x).alias("ext"), F.lit(text).alias("text")) for x, text, _ in SOURCES])
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(key.alias("key"), F.explode(each).alias("s"))
    # What looks like a mark but belongs to the language is an at sign that no name goes before.
    return rows.select(F.concat(F.lit("of/"), "key", F.lit("."), "s.ext").alias("path"), F.regexp_replace("s.text", "_@", F.concat(F.lit("_"), "key")).alias("content"))


def _sql(x: str | int) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


SYMBOLS_SQL = "want(ext, name, kind, line_start, line_end) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, (x, *s))) + ")" for x, _, found in SOURCES for s in found) + ")"

"""A code corpus derived from the ``documents`` table.

The table holds prose.  Every document becomes one submission: code fragments picked by its
length, followed by all of its lines as comments.  Documents with equal texts become equal code.
Some documents are followed by another submission that must be rejected: no code, or no id.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PY_IMPORTS = [
    "import os", "import sys, shutil", "import json as codec", "import math", "from typing import (Iterable,\n    Mapping as Table)",
    "import textutils", "from systools.core import read, scale", "import collections.abc", "from os.path import *",
    "from . import stations", "import re; import random", "from __future__ import annotations", "import json",
    "try:\n    import collections_extra as more\nexcept ImportError:\n    more = None", "import xml.etree.ElementTree as ET, os_utils",
]
PY_BODY = [
    "def mean_@N@(low, high):\n    return (low + high) / 2",
    "def label_@N@(station, unit=None):\n    head = unit.symbol\n    return f'{station}: {head}'",
    "def depth_@N@(probe=None, backup=None):\n    if probe is None:\n        return backup[0]\n    return probe.reading",
    "def level_@N@(row: dict = None, *, mark=None):\n    if not row:\n        return mark.height\n    return row['cm'].value",
    "def reset_@N@(port):\n    for attempt in range(3):\n        try:\n            port.write(attempt)\n        except:\n            pass",
    "def parse_@N@(line):\n    try:\n        cells = [float(c),\n                 0]\n    except (ValueError, IndexError) as bad:\n        pass\n    finally:\n        closed = True",
    "try:\n    limit_@N@ = 40\nexcept LookupError: pass\nexcept ArithmeticError:\n    print('retry')",
    'UPLOAD_TOKEN = "station-upload-@N@"',
    "pwd = 'brief'  # secret = 'buoy channel @N@'",
    "def flood_@N@(levels, banks, alarms):\n    worst = None\n    for name, cm in levels.items():\n        if cm > banks[name] and name in alarms or cm > 900:\n            for alarm in alarms[name]:\n                if alarm.armed:\n                    worst = name if worst is None else worst\n                elif alarm.test:\n                    alarm.reset()\n    while worst and not alarms:\n        break\n    return worst",
    "def merged_@N@(left, right):\n    def nearer(point):\n        return point and (left or right and point) and [p for p in right if p]\n    with open(left) as near, open(right) as far:\n        if near or far:\n            return nearer(near) or far\n    try:\n        return left if right else nearer(left)\n    except OSError:\n        raise",
    "wells_@N@ = re.matchAll(pattern, rows)\nnames = str.format_map_safe(wells_@N@)",
    "folders_@N@ = os.listdir(base, 'deep', 'hidden')",
    "area_@N@ = math.ceil(2, 3) + math.sqrt(x=1) + os.getenv('GAUGE', 'none') + os.rename(*pair)",
    "draw_@N@ = random.randint(1, *[2, 3], **kw) + random.random(0)",
    "class Gauge_@N@(Sensor, metaclass=Registry):\n    width: int = 3\n\n    @staticmethod\n    def build(cls, river=None, label='x'):\n        return river.branch(label, lambda a, b=2: (a, b))\n\n    async def poll(self, link=None):\n        async with link.lock:\n            await link.send()",
    "def banner_@N@(codec):\n    return f\"{codec.dumps(1)} at {os.getcwd()!r:>{width}}\" + f'{sys.path[0]}'",
    "if __name__ == '__main__':\n    print(os.path.join('log', \"tide's # no remark\"), sys.argv)",
    "notes_@N@ = \'\'\'\nimport nothing_real\ndef half_open(:\n\'\'\'\nratio = 0x2A + 3_500.25e2 - .75",
    "sum_@N@ = 7 + \\\n    8; rest = 3; del rest",
    "re.search('cm')\nre.split(r'\\s+', 'a b', 1, 2, 3)\njson.parse('{}')\nos.read_file('x')",
    "def drained_@N@(tank=None):\n    while tank:\n        inflow = tank['in']\n        if tank == None:\n            break\n    return inflow",
    "def peeked_@N@(tank=None, valves=None):\n    return [tank['in'] for _ in valves.values() if valves.get(1, 2)]",
    "wet_@N@ = [day for day, mm in zip(days, rain) if mm if day]\nby_day = {d: m for d, m in rows}\nprint(any(m for d, m in rows))",
]
PY_BROKEN = [
    "def half_@N@(:\n    pass", "span = (3, 4]", "while wet\n    dry = 0", "class Empty:\nunit = 1", "name = 'buoy", "  shifted = 1",
    "print 'level'", "if wet:\n        a = 1\n    b = 2", "cm = 4 $ 5", "rows = [8, 9",
]
JAVA_IMPORTS = [
    "import java.util.Deque;", "import java.util.*;", "import nowhere.Gauge;", "import static org.junit.Assert.assertTrue;",
    "import java.io.Reader;\nimport java.util.Queue;", "import com.harbour.tools.Buoy;", "import javax.swing.JLabel;",
    "import Single;", "import java.util.TreeMap; // TreeMap is told here only", "import org.json.JSONArray;",
]
JAVA_BODY = [
    "    static long product@N@(long width, long depth) {\n        return width * depth;\n    }",
    "    String shout@N@(String river) {\n        String upper = river.toUpperCase();\n        return upper + '!';\n    }",
    "    public String first@N@(String river, Map<String, List<String>> gauges) {\n        if (river != null) {\n            return river.strip();\n        }\n        return gauges.get(\"x\").toString();\n    }",
    "    void flush@N@(Channel out) throws Closed {\n        for (int turn = 0; turn < 3; turn++) {\n            try {\n                write(out, turn);\n            } catch (Exception refused) {\n                // tried again below\n            }\n        }\n    }",
    "    void moor@N@() throws IOException {\n        try {\n            tie();\n        } catch (final IllegalStateException | IOException loose) {\n        } catch (Throwable storm) {\n            report(storm);\n        } finally {\n            settle();\n        }\n    }",
    "    static final String UPLOAD_TOKEN@N@ = \"station-upload-@N@\";",
    "    private String secret = \"abc\"; // token \"\"",
    "    int alarms@N@(int[] levels, int bank, int margin) {\n        int raised = 0;\n        for (int cm : levels) {\n            if (cm > bank && cm < 900 || margin == 0) {\n                raised += cm - bank > margin ? 2 : 1;\n            } else if (cm < 0) {\n                break;\n            }\n        }\n        while (raised > 9) { raised--; }\n        do { margin--; } while (margin > 0);\n        if (raised == 1) { bank = 0; }\n        return raised;\n    }",
    "    int unit@N@(int kind, String[] names, String... more) {\n        switch (kind) {\n            case 1:\n            case 2:\n                return names.length;\n            case 3: return more.size();\n            default: return 0;\n        }\n    }",
    "    float tilt@N@(float rise) {\n        float slope = (float) Math.power(rise, 2);\n        return slope + Integer.parse(\"3\");\n    }",
    "    void trim@N@() {\n        long far = Math.abs(4, 5) + Math.min(2, Math.max(1, 2), 7);\n        String shown = String.join(\",\");\n        Arrays.sort(cells, new Range<Long, Integer>(1, 2), 3, 4);\n    }",
    "    void spell@N@() {\n        Sytem.gc(); Arays.sort(cells);\n        Integers.parseInt(\"7\");\n        Sets.of(1, 2);\n    }",
    "    void buffer@N@() {\n        java.util.Deque<Long> queueOfLevels = new java.util.ArrayDeque<Long>();\n        queueOfLevels.push(7L);\n        boolean none = queueOfLevels.isEmpty();\n    }",
    "    interface Bank@N@ {\n        double height(double tide);\n        List<String> gauges();\n    }",
    "    Runnable watch@N@ = new Runnable() {\n        @Override\n        public void run() {\n            Objects.equals(1);\n        }\n    };",
    "    public Buoy@N@(String label) {\n        this.label = label.strip();\n    }",
    "    boolean meets@N@(Reach upper, Reach lower, int km) {\n        return upper.end == lower.start && km == 5 && lower.next().touches(upper);\n    }",
    "    void lock@N@(Gate inner, Gate outer) {\n        if (harbour.inner == null) return;\n        inner.close(); outer.close();\n        outer.close();\n    }",
    "    char mark = '\"'; String path = \"c\\\"d\"; /* import not.Code;\n       catch (Exception e) { } */ int width = 3;",
    "    List<Map<String, ? extends Number>> table@N@(Map<String, Integer> in) {\n        System.out.println(in.size() > 2 ? \"many\" : \"few\");\n        return in.isEmpty() ? null : make(in);\n    }",
]
JAVA_BROKEN = [
    "    private long open@N@( { }", "    int cm = (1 + 2];", "    String s = \"buoy;", "    }", "    void half() {",
]


def _pick(fragments: list[str], slot: Column) -> Column:
    n = F.col("n_chars")
    index = (n * (slot * 2 + 7) + slot * 13) % len(fragments)
    return F.element_at(F.array(*[F.lit(f) for f in fragments]), (index + 1).cast("int"))


def _picks(fragments: list[str], first: int, count: Column) -> Column:
    slots = F.sequence(F.lit(first), F.lit(first) + count - 1)
    return F.array_join(F.transform(slots, lambda slot: _pick(fragments, slot)), "\n")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions derived from all documents of ``sf_dir``."""
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def from_documents(documents: DataFrame) -> DataFrame:
    """The derivation itself; narrow, so it works on streams too."""
    n, doc = F.col("n_chars"), F.col("doc_id")
    broken = n % 40 == 0
    nothing = F.lit("")
    body_count = (n % 4 + 3).cast("int")
    import_count = (n % 3 + 1).cast("int")

    def fault(fragments):
        chosen = F.element_at(F.array(*[F.lit(f) for f in fragments]), (F.floor(n / 40) % len(fragments) + 1).cast("int"))
        return F.when(broken, F.concat(chosen, F.lit("\n"))).otherwise(nothing)

    def told(mark):
        return F.concat(F.lit(mark), F.replace(F.col("text"), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))

    py = F.concat(
        _picks(PY_IMPORTS, 0, import_count), F.lit("\n\n"), _picks(PY_BODY, 1, body_count), F.lit("\n"),
        fault(PY_BROKEN), told("# "),
    )
    java = F.concat(
        _picks(JAVA_IMPORTS, 0, import_count), F.lit("\n\npublic class Doc@N@ {\n"), _picks(JAVA_BODY, 1, body_count),
        F.lit("\n"), fault(JAVA_BROKEN), F.lit("}\n"), told("// "),
    )
    def submitted(code, *more):
        """The submission of a document, and another one without code or without an id after some of them."""
        own = F.struct(code.alias("code"), F.lit(False).alias("extra"), F.lit(False).alias("no_id"))
        if not more:
            return F.array(own)
        return F.array(own, F.struct(F.lit(more[0]).cast("string").alias("code"), F.lit(True).alias("extra"),
                                     F.lit(len(more) > 1).alias("no_id")))

    is_java = doc % 2 == 1
    code = F.replace(F.when(is_java, java).otherwise(py), F.lit("@N@"), n.cast("string"))
    return documents.select(
        doc.alias("file_id"),
        F.when(doc % 70 == 0, F.lit(None).cast("string"))
        .when((doc % 50 == 0) | (doc % 30 == 15), F.format_string("doc_%d.txt", doc))
        .when(is_java & (doc % 14 == 1), F.format_string("doc_%d.JAVA", doc))
        .when(is_java, F.format_string("doc_%d.java", doc))
        .otherwise(F.format_string("doc_%d.py", doc)).alias("filename"),
        F.when(doc % 30 == 0, "python").when(doc % 30 == 15, "java").when(doc % 30 == 7, "Java").alias("language_override"),
        F.explode(F.when(doc % 90 == 4, submitted(code, "")).when(doc % 90 == 8, submitted(code, " \n\t "))
                  .when(doc % 90 == 12, submitted(code, None)).when(doc % 90 == 16, submitted(code, "pass\n", True))
                  .otherwise(submitted(code))).alias("s"),
        F.timestamp_seconds(F.lit(1700000000) + doc).alias("submitted_at"),
    ).select(
        F.when(~F.col("s.no_id"), F.when(F.col("s.extra"), -1 - F.col("file_id")).otherwise(F.col("file_id"))).alias("file_id"),
        "filename", "language_override", F.col("s.code").alias("code"), "submitted_at",
    )

"""Functions from a table to a table, for SQL:

    register(spark)
    SELECT * FROM text_segments(TABLE(conversations), 'conv_id', 'turn', 'text')
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class TextSegments:
    """Lines of the texts of each part, numbered on from row to row, with their places in the part's whole text.

    The arguments name the columns of the key, of the order within a key, and of the text. Result: key, order,
    sequence (from 0), start_offset, end_offset (in code points of the key's texts, joined by line ends), segment,
    segment_hash. Rows with a null text have no segments and take no place; an empty text is one empty segment; null
    keys are one part; rows of equal order follow by text. A part's rows are streamed, so that memory is that of a row.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table, as in TABLE(name)")
        names = [a.value for a in (key, order, text)]
        fields = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [n for n in names if n not in fields]
        if missing:
            raise ValueError(f"the table has no column {', '.join(map(str, missing))}")
        if not isinstance(fields[names[2]], T.StringType):
            raise ValueError(f"{names[2]} is no text")
        schema = T.StructType([T.StructField(n, fields[n]) for n in names[:2]])
        for name, kind in (("sequence", T.LongType()), ("start_offset", T.LongType()), ("end_offset", T.LongType()), ("segment", T.StringType()), ("segment_hash", T.StringType())):
            schema.add(name, kind)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(_quoted(names[0]))], orderBy=[OrderingColumn(_quoted(names[1])), OrderingColumn(_quoted(names[2]))])

    def __init__(self):
        self.sequence = self.at = 0

    def eval(self, row, key, order, text):
        if row[text] is None:
            return
        for segment in row[text].split("\n"):
            yield row[key], row[order], self.sequence, self.at, self.at + len(segment), segment, hashlib.sha256(segment.encode()).hexdigest()
            self.sequence += 1
            self.at += len(segment) + 1


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_segments", F.udtf(TextSegments, useArrow=True))

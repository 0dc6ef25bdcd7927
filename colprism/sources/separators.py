"""Finding the separator of a delimited file from its first lines."""

from __future__ import annotations

import csv

from pyspark.sql import SparkSession

from colprism.functions import fixed


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of a file; a tab for ``.tsv``.

    Looks at up to 20 lines, since a quoted header misleads a guess made from
    the header alone.
    """
    if str(path).lower().endswith(".tsv"):
        return "\t"
    lines = [r["value"] for r in spark.read.text(path).limit(20).collect() if r["value"].strip()]
    return separator_of_lines(lines)


def separator_of_lines(lines: list[str]) -> str:
    if not lines:
        return ","
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters="".join(fixed.SEPARATORS)).delimiter
    except csv.Error:
        pass
    widths = {}
    for sep in fixed.SEPARATORS:
        counts = {len(row) for row in csv.reader(lines, delimiter=sep)}
        if len(counts) == 1 and max(counts) > 1:
            widths[sep] = counts.pop()
    return max(widths, key=widths.get) if widths else ","

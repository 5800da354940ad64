"""SQL names for the sequence functions, so that they can be used from spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, type, body) of SQL functions; bodies are SQL, so they are inlined into plans.
FUNCTIONS = {
    "star_valid": ("s STRING", "BOOLEAN", "length(regexp_replace(s, '[^*]', '')) % 2 = 0 AND NOT contains(s, '**')"),
    "seq_type": (
        "s STRING",
        "STRING",
        "CASE WHEN length(regexp_replace(s, '[^*]', '')) % 2 = 1 OR contains(s, '**') THEN '* DELIMITER MISTAKE' WHEN s RLIKE '^([ACGT*]*|[ACGU*]*)$' THEN 'NUCLEIC ACID' WHEN s RLIKE '^[ACGUT*]*$' THEN 'UT MISTAKE' ELSE 'TEXT' END",
    ),
    "revcomp": ("s STRING", "STRING", "reverse(translate(s, 'ACGTU', 'TGCAA'))"),
    "to_rna": ("s STRING", "STRING", "translate(s, 'T', 'U')"),
    "to_dna": ("s STRING", "STRING", "translate(s, 'U', 'T')"),
    "poly_t": ("s STRING", "STRING", "regexp_replace(s, '(T{4,})', '*$1*')"),
    "scaffold_index": ("i INT, n INT, circular BOOLEAN", "INT", "CASE WHEN circular THEN pmod(i, n) WHEN i < 0 OR i >= n THEN -1 ELSE i END"),
}

# letters of the whole text before it is cut into lines, as a word a line would make each step a call
_LINES = r"""filter(transform(split(upper(replace(replace(replace(replace(body, '\r\n', '\n'), '\r', '\n'), '\t', ''), ' ', '')), '\n'), (x, i) -> named_struct('line_no', i + 1, 's', x)),
  x -> x.s <> '' AND NOT startswith(x.s, '#'))"""
_NUCLEIC = "NOT (x.s RLIKE '[^ACGTU*]') AND NOT (contains(x.s, 'T') AND contains(x.s, 'U')) AND (NOT contains(x.s, '*') OR (length(x.s) - length(replace(x.s, '*', ''))) % 2 = 0 AND NOT contains(x.s, '**'))"

#: name: (parameters, columns, query) of SQL table functions, to be joined laterally with a table that has texts.
TABLES = {
    #: the lines of an input file: its topology lines, and its sequences, of which the first is the scaffold
    "rev_lines": (
        "body STRING",
        "line_no INT, kind STRING, staple_id INT, seq STRING",
        f"""SELECT inline(flatten(transform(array({_LINES}), l -> concat(
          transform(filter(l, x -> x.s IN ('LINEAR', 'CIRCULAR')), x -> named_struct('line_no', x.line_no, 'kind', 'topology', 'staple_id', CAST(NULL AS INT), 'seq', x.s)),
          transform(filter(l, x -> x.s NOT IN ('LINEAR', 'CIRCULAR')), (x, k) -> named_struct('line_no', x.line_no,
            'kind', CASE WHEN NOT ({_NUCLEIC}) THEN 'error' WHEN k = 0 THEN 'scaffold' ELSE 'staple' END, 'staple_id', CASE WHEN k > 0 THEN k - 1 END, 'seq', x.s))))))""",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions for this session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, query) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return [*FUNCTIONS, *TABLES]

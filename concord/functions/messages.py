"""Texts of errors, reasons and mismatches, and how they are filled from columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

# Texts that reports and callers match on.
UNKNOWN_DATASET = "no Dataset definition found for '{dataset}'"
UNBOUND_DATASET = "dataset '{dataset}' has no binding for environment '{environment}'"
NOT_AN_ARTIFACT = "not an artifact:// reference: {reference}"
MALFORMED_ARTIFACT = "malformed artifact reference (expected artifact://<name>/<version>): {reference}"
UNBOUND_ARTIFACT = "artifact '{name}/{version}' has no binding for environment '{environment}'"
PIPELINE_NEEDS_SPEC = "pipelineSpec is required when type is 'spark-declarative-pipeline'"
BUILD_NEEDS_ENTRY = "artifact and entryPoint are required when type is '{type}'"
UNSUPPORTED_SPARK = "unsupported Spark version: {version}"
UNSUPPORTED_LANGUAGE = "unsupported language: {language}"
UNSUPPORTED_FEATURE = "workload requires {feature}, provider does not support it"
NO_SPARK_VERSIONS = "execution provider reports no supported Spark versions"
RUN_NOT_FOUND = "run '{run}' not found"
RUN_NOT_SUCCEEDED = "run not SUCCEEDED (state={state})"
NO_OUTPUTS = "workload declares no output datasets"
NO_SUCH_OUTPUT = "workload has no output named '{output}'"
UNBOUND_OUTPUT = "no dataset binding for '{dataset}' in '{environment}'"
CLAIMED = "claimed for submission"
SCHEMA = "schema mismatch: left={left} right={right}"
ROW_COUNT = "row count mismatch: left={left} right={right}"
NULL_COUNT = "null count mismatch on '{column}': left={left} right={right}"
AGGREGATE = "{check}('{column}') mismatch: left={left} right={right}"
COVERAGE = "partition coverage mismatch: left={left} right={right}"
ROW_CONTENT = "row content mismatch: deterministic row hashes differ"

# Texts of this library.
INVARIANT = "invariant violated: {column}: left={left} right={right}"
NO_EVIDENCE = "this exact pair has no live evidence"
NO_CATALOG = "a table dataset binding is present but the environment's storage profile has no catalog uri or warehouse"
STALE_RUNTIME = "runtime key '{key}' (curated for Spark {version}) was not found in the workspace"
RENAMED_RUNTIME = "runtime key '{key}' is known as '{name}', which does not mention Spark {version}"


def say(text: str, **parts: Column) -> Column:
    """``text`` with its ``{names}`` replaced by columns, a NULL one by the word NULL. Never NULL itself: whether there
    is an error is decided by a condition, not by what the text can show."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(text):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(parts[name].cast("string"), F.lit("NULL")))
    return F.concat(*pieces)

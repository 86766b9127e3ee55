"""Path selections over JSON data, as Spark plans."""

from pathloom.functions.variant import drop_keys, has_keys, keys_match, kind
from pathloom.operators.select import select
from pathloom.plans.ast import PathExpr
from pathloom.plans.builder import PathBuilder
from pathloom.plans.matcher import covers, matches_keys, select_values
from pathloom.plans.parser import PathSyntaxError, parse_path
from pathloom.sources.readers import good_and_bad, read_documents, stream_documents, strictly
from pathloom.streaming.select import select_stream

__all__ = ["PathBuilder", "PathExpr", "PathSyntaxError", "covers", "drop_keys", "good_and_bad", "has_keys", "keys_match", "kind", "matches_keys", "parse_path", "read_documents", "select", "select_stream", "select_values", "stream_documents", "strictly"]

"""Parsing as an operator: documents in; verdicts, canonical texts, node and finding tables out.

A document is read in one pass of an Arrow map, so rows don't move.  Where several tables
are wanted from one corpus, write ``parse_documents`` to a table first and explode from
there; reading twice costs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grammar.tree import NODE_FIELDS

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
NODE_SCHEMA = {"node_id": "int", "parent_id": "int", "subtree_end": "int", "depth": "int", "slot": "string", "pos": "int", "type": "string", **NODE_FIELDS, "start_off": "bigint", "end_off": "bigint"}
FINDING_SCHEMA = {"seq": "int", "category": "string", "severity": "string", "message": "string", "start_off": "bigint", "end_off": "bigint"}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _struct(fields: dict[str, str]) -> pa.DataType:
    return pa.struct([(k, _ARROW[v]) for k, v in fields.items()])


#: Inputs up to this many bytes for each core are dealt out anew before a map that costs far more than its bytes.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores, where the plan's size says that a scan or shuffle would leave most cores idle.

    What is moved is bounded by ``SPREAD_BYTES`` a core; larger inputs have enough partitions and stay.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(3 * cores) if size <= SPREAD_BYTES * cores else df


def per_document(df: DataFrame, read: Callable[[object, str | None], list[tuple]], fields: dict[str, str], types: list[pa.DataType], key: str = "doc_id", text: str = "text", rows: int = 200) -> DataFrame:
    """Maps every (key, text) to rows of ``fields``; small output batches keep memory bounded."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                keys = batch.column(0).slice(start, rows)
                at: list[int] = []
                out: list[tuple] = []
                for i, (own, body) in enumerate(zip(keys.to_pylist(), batch.column(1).slice(start, rows).to_pylist(), strict=True)):
                    found = read(own, body)
                    at += [i] * len(found)
                    out += found
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *columns], names=[key, *fields])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, {_ddl(fields)}")


def _findings(parsed) -> list[dict]:
    project = parsed.transport.to_source if parsed.transport else (lambda x: x)
    return [
        {"seq": i, "category": f.category, "severity": f.severity, "message": f.message, "start_off": None if f.start is None else project(f.start), "end_off": None if f.end is None else project(f.end)}
        for i, f in enumerate(parsed.findings)
    ]


def parse_documents(df: DataFrame, key: str = "doc_id", text: str = "text", nodes: bool = True, max_bytes: int | None = None, max_frames: int = 1000, max_nodes: int | None = None) -> DataFrame:
    """``(key, status, canonical, canonical_hash, n_nodes, findings, nodes)`` for each document.

    ``status`` is ok, invalid or resource; an invalid document keeps its recovered nodes.
    ``canonical`` is null unless the document is valid and can be written.  Null texts are
    the empty document.
    """
    fields = {"status": "string", "canonical": "string", "canonical_hash": "string", "n_nodes": "int", "findings": f"array<struct<{', '.join(f'{k}:{v}' for k, v in FINDING_SCHEMA.items())}>>"}
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(_struct(FINDING_SCHEMA))]
    if nodes:
        fields["nodes"] = f"array<struct<{', '.join(f'{k}:{v}' for k, v in NODE_SCHEMA.items())}>>"
        types.append(pa.list_(_struct(NODE_SCHEMA)))

    def read(_, body):
        from ..grammar.api import _written
        from ..grammar.document import read_document
        from ..grammar.tree import rows_of

        parsed = read_document(body, max_bytes, max_frames, max_nodes)
        canonical = _written(parsed)
        rows = rows_of(parsed.tree, parsed.transport.to_source) if nodes and parsed.tree else []
        digest = None if canonical is None else hashlib.sha256(canonical.encode("utf-8", "replace")).hexdigest()
        count = len(rows) if nodes else sum(1 for _ in parsed.tree.walk()) if parsed.tree else 0
        return [(parsed.status, canonical, digest, count, _findings(parsed), *([_as_arrow(rows)] if nodes else []))]

    return per_document(df, read, fields, types, key, text)


def _as_arrow(rows: list[dict]) -> list[dict]:
    for r in rows:
        if "data_attrs" in r:
            r["data_attrs"] = sorted(r["data_attrs"].items())
    return rows


def node_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The nodes of all documents, one row each, with nested-set intervals."""
    def read(_, body):
        from ..grammar.document import read_document
        from ..grammar.tree import rows_of

        parsed = read_document(body)
        rows = _as_arrow(rows_of(parsed.tree, parsed.transport.to_source)) if parsed.tree else []
        return [tuple(r.get(k) for k in NODE_SCHEMA) for r in rows]

    return per_document(df, read, NODE_SCHEMA, [_ARROW[v] for v in NODE_SCHEMA.values()], key, text)


def finding_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The findings of all documents in the order in which they were made."""
    def read(_, body):
        from ..grammar.document import read_document

        return [tuple(f.values()) for f in _findings(read_document(body))]

    return per_document(df, read, FINDING_SCHEMA, [_ARROW[v] for v in FINDING_SCHEMA.values()], key, text)


def canonical_verdicts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, verdict, canonical, reasons)``: canonical, noncanonical, invalid or resource."""
    def read(_, body):
        from ..grammar.api import check_canonical

        verdict, canonical, why = check_canonical(body or "")
        return [(verdict, canonical, [f.message for f in why])]

    return per_document(df, read, {"verdict": "string", "canonical": "string", "reasons": "array<string>"}, [pa.string(), pa.string(), pa.list_(pa.string())], key, text)


def validation_table(df: DataFrame, key: str = "doc_id", text: str = "text", identity: bool = False) -> DataFrame:
    """``(key, status, findings)`` of the tree that each valid text has; invalid texts keep their reading's findings."""
    fields = {"status": "string", "findings": f"array<struct<{', '.join(f'{k}:{v}' for k, v in FINDING_SCHEMA.items())}>>"}

    def read(_, body):
        from ..grammar.api import validate
        from ..grammar.document import read_document

        parsed = read_document(body)
        if parsed.status != "ok":
            return [(parsed.status, _findings(parsed))]
        parsed_status, parsed.findings = validate(parsed.tree, identity)
        return [(parsed_status, _findings(parsed))]

    return per_document(df, read, fields, [pa.string(), pa.list_(_struct(FINDING_SCHEMA))], key, text)


def adopt_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, status, added_ids, adopted)``: the canonical text with an id on every eligible block."""
    def read(own, body):
        from ..grammar.api import adopt
        from ..grammar.document import read_document
        from ..grammar.tree import Unwritable
        from ..grammar.writer import write_document

        parsed = read_document(body)
        if parsed.status != "ok":
            return [(parsed.status, None, None)]
        added = adopt(parsed.tree, own)
        try:
            return [("ok", added, write_document(parsed.tree))]
        except Unwritable:
            return [("invalid", added, None)]

    return per_document(df, read, {"status": "string", "added_ids": "bigint", "adopted": "string"}, [pa.string(), pa.int64(), pa.string()], key, text)


def run_command(df: DataFrame, command: str, strict: bool = False, check: bool = False, stdout: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The command line as a batch job: ``check``, ``format`` or ``adopt`` with exit code, output and new content.

    0 is success, 1 a document that fails; findings read ``line:column: severity[category]: message``.
    ``check`` of format or adopt only says what would change; ``stdout`` says that the new
    content isn't written back, which is up to the caller.  The flags exclude each other as
    on the command line.
    """
    if command not in ("check", "format", "adopt"):
        raise ValueError(f"no such command: {command}")
    if check and stdout or command == "check" and (check or stdout) or command == "adopt" and strict:
        raise ValueError(f"{command} doesn't take these flags together")

    def read(own, body):
        from ..grammar.api import _written, adopt, check_canonical
        from ..grammar.document import read_document

        body = body or ""
        parsed = read_document(body)
        found, content, code = parsed.findings, None, 0 if parsed.status == "ok" else 1
        if code == 0 and strict:
            verdict, _, why = check_canonical(body)
            found, code = (found, 0) if verdict == "canonical" else (why, 1)
        if code == 0 and command != "check":
            if command == "adopt":
                adopt(parsed.tree, own)
            content = _written(parsed)
            code = int(content is None or check and content != body)
        return [(code, "\n".join(_line_of(parsed, f) for f in found), None if check else content)]

    return per_document(df, read, {"exit_code": "int", "output": "string", "new_content": "string"}, [pa.int32(), pa.string(), pa.string()], key, text)


def _line_of(parsed, f) -> str:
    if f.start is None:
        return f"{f.severity}[{f.category}]: {f.message}"
    text = parsed.transport.text
    line = text.count("\n", 0, f.start) + 1
    return f"{line}:{f.start - (text.rfind(chr(10), 0, f.start) + 1) + 1}: {f.severity}[{f.category}]: {f.message}"


def exploded(parsed: DataFrame, what: str, key: str = "doc_id") -> DataFrame:
    """The ``nodes`` or ``findings`` of a stored result of ``parse_documents`` as a table."""
    return parsed.select(key, F.explode(what).alias("_x")).select(key, "_x.*")

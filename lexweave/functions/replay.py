"""Amendments of one law after the other, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import fixed

#: What a row is; a law's rows come in this order, its events in theirs.
LAW, PROVISION, EVENT = 0, 1, 2

INPUT = ["law", "_kind", "_base_no", "event_id", "operation", "effective_date", "node_type", "number", "new_text", "renumber_to"]

KNOWN = frozenset(fixed.AMENDMENT_OPERATIONS)

#: Columns of a row that `Law` makes, before those of its law and of its version numbers.
_DATE, _TO, _N, _NEXT = 6, 7, 12, 13


class Law:
    """The provisions of a law, under the numbers they have now, and what its events made of them.

    Held are the rows the events make, until the law is over: a row tells when the next event changes its provision.
    """

    def __init__(self, name: str):
        self.name, self.base_nos, self.made = name, [], []
        self.at: dict[tuple, str] = {}  # who has a number
        self.text: dict[str, str | None] = {}  # of provisions that are not deleted
        self.changed: dict[str, list] = {}  # the last row that changed or renumbered a provision
        self.events, self.repealed = 0, False

    def provision(self, node_type: str | None, number: str | None, text: str | None) -> None:
        if node_type is not None and number is not None:
            who = self.at[node_type, number] = f"base|{self.name}|{node_type}|{number}"
            self.text[who] = text

    def event(self, event_id, operation, date, node_type, number, new_text, renumber_to) -> None:
        self.events += 1
        who, node = None, (node_type, number)
        moves = False
        if node_type is not None and number is not None and operation in KNOWN:
            who = self.at.get(node)
            if who is None and operation == "INSERT":
                who = self.at[node] = f"I|{self.events}"
            moves = who is not None and operation == "RENUMBER" and renumber_to is not None and renumber_to != number
            if moves:
                del self.at[node]
                self.at[node_type, renumber_to] = who
        # Numbers change hands by rejected events too, where a law is repealed already.
        if self.repealed or (operation is not None and operation not in KNOWN) or (node_type is not None and who is None):
            return
        self.repealed = operation == "REPEAL"
        n = len(self.made) + 1
        alive, before = who in self.text, self.text.get(who)
        changes, after = False, before
        if who is not None:
            if operation == "INSERT" or (operation == "REPLACE" and alive):
                changes, after = True, new_text
                self.text[who] = new_text
            elif operation == "DELETE":
                changes, after = True, None
                self.text.pop(who, None)
        if self.made:
            self.made[-1][_TO] = date
        row = [event_id, operation, node_type, number, renumber_to, who, date, None, before, new_text, after, changes, n, None]
        self.made.append(row)
        if changes or moves:
            last = self.changed.get(who)
            if last is not None:
                last[_NEXT] = n
            self.changed[who] = row


def _values(column: pa.Array) -> list:
    """`to_pylist` of strings and numbers, several times faster."""
    numbers = pa.types.is_integer(column.type)
    if not numbers and not pa.types.is_string(column.type):
        return column.to_pylist()
    if not numbers or not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    out = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    for i in column.is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
        out[i] = None
    return out


def replayed(rows: DataFrame, schema: StructType) -> DataFrame:
    """What the accepted events of each law make, from the rows of whole laws in order, each with its `_kind`.

    `schema` is that of the result: law, what a row of `Law` holds but the numbers, version_number and next_change.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law, columns, types = None, [[] for _ in schema.fields], None

        def end() -> None:
            for base in law.base_nos if law is not None and law.made else ():
                made = list(zip(*law.made, strict=True))
                columns[0].extend([law.name] * len(law.made))
                for out, values in zip(columns[1:], made[:_N], strict=False):
                    out.extend(values)
                # A law without a number has versions without one.
                columns[-2].extend([None if base is None else base + n for n in made[_N]])
                columns[-1].extend([None if base is None or n is None else base + n for n in made[_NEXT]])

        def batch() -> pa.RecordBatch:
            arrays = [
                pa.array(x, number).cast(kind) if number is not None else pa.array(x, kind)
                for x, (kind, number) in zip(columns, types, strict=True)
            ]
            for x in columns:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for read in batches:
            held = dict(zip(read.schema.names, read.columns, strict=True))
            day = held["effective_date"].type
            number = pa.int32() if pa.types.is_date32(day) else pa.int64()
            if types is None:
                own = {"law": held["law"].type, "event_id": held["event_id"].type, "changed": pa.bool_()}
                own |= dict.fromkeys(("version_number", "next_change"), pa.int64())
                days = dict.fromkeys(("effective_from", "effective_to"), (day, number))
                types = [days.get(f, (own.get(f, pa.string()), None)) for f in schema.names]
            held["effective_date"] = held["effective_date"].cast(number)
            for name, kind, base, event_id, operation, date, node_type, of, text, to in zip(*[_values(held[c]) for c in INPUT], strict=True):
                if law is None or name != law.name:
                    end()
                    law = Law(name)
                    if len(columns[0]) >= 10_000:
                        yield batch()
                if kind == EVENT:
                    law.event(event_id, operation, date, node_type, of, text, to)
                elif kind == PROVISION:
                    law.provision(node_type, of, text)
                else:
                    law.base_nos.append(base)
        end()
        if columns[0]:
            yield batch()

    return rows.select(*INPUT).mapInArrow(run, schema)

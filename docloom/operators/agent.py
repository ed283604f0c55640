"""The agent's turn as a keyed state machine (M04): retrieve, route, fix, remember, turn after turn of each conversation.

A conversation's state is its product rows and the keys of its memories.  A user's turn retrieves what is remembered so far,
is routed (B20), applies the proposed changes if it is a fix (C17: by row index, removals, renames that the description
holds), and is remembered with its renames (E12, A21).  Later turns see the rows as earlier ones left them, so indexes move.

:func:`run_turns` is for tables: rows are dealt by conversation and sorted by turn, and a task folds them as they come, so a
long conversation is no group in memory.  :func:`stream_turns` is for streams and keeps the state between batches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.predicates import route
from ..plans.deploy import ship

CHANGES = "array<struct<index: int, product_name: string, remove: boolean>>"
TOLD = "turn bigint, intent string, hits bigint, renamed bigint, removed bigint, rows_left bigint, product_names array<string>"
COLUMNS = [c.split(" ")[0] for c in TOLD.split(", ")]
#: Share of a new name's words that the description must hold, most memories that a turn retrieves.
GROUNDED, HITS = 0.55, 4


def holds(description: str | None, name: str) -> bool:
    text, wanted = (description or "").lower(), name.lower()
    words = re.findall(r"\w+", wanted)
    return bool(text) and (wanted in text or bool(words) and sum(w in text for w in words) / len(words) >= GROUNDED)


class Conversation:
    """The state of one conversation, as JSON between batches."""

    def __init__(self, stored: str | None = None):
        self.products, self.memories = json.loads(stored) if stored else ([], [])
        self.known = set(self.memories)

    def stored(self) -> str:
        return json.dumps([self.products, self.memories])

    def _remember(self, conv: str, role: str, text: str | None) -> None:
        text = (text or "").strip()
        key = hashlib.sha1(f"{conv}:{role}:{text[:200]}".encode()).hexdigest()[:24]
        if len(text) >= 2 and key not in self.known:
            self.known.add(key)
            self.memories.append(key)

    def take(self, conv: str, row) -> tuple | None:
        """What a row (turn, role, text, intent, changes, products) makes of the conversation; a user's turn is told."""
        if row.products is not None:
            self.products = [[p["description"], p["product_name"]] for p in row.products]
            return None
        if row.role != "user":
            self._remember(conv, row.role, row.text)
            return None
        hits, renamed, removed = min(HITS, len(self.memories)), [], set()
        intent = row.intent if self.products else "chat"
        if intent == "fix" and row.changes is not None:
            for c in row.changes:
                k, name = c["index"], (c["product_name"] or "").strip()
                if k is None or not 0 <= k < len(self.products):
                    continue
                if c["remove"]:
                    removed.add(k)
                elif len(name) >= 2 and holds(self.products[k][0], name):
                    self.products[k][1] = name
                    renamed.append(f"{(self.products[k][0] or '')[:120]} -> {name}")
            self.products = [p for k, p in enumerate(self.products) if k not in removed]
        self._remember(conv, "user", row.text)
        for text in renamed:
            self._remember(conv, "assistant", text)
        return row.turn, intent, hits, len(renamed), len(removed), len(self.products), [p[1] for p in self.products]


def _told(rows: list[tuple], conv: Iterable) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    out.insert(0, "conv_id", list(conv))
    return out


def events(turns: DataFrame, changes: DataFrame, products: DataFrame) -> DataFrame:
    """One row per turn (conv_id, turn, role, text) with its changes (conv_id, turn, seq_no, index, product_name, remove), and one
    before all turns with the conversation's products (conv_id, seq, description, product_name)."""
    of = changes.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", "index", "product_name", F.coalesce("remove", F.lit(False)).alias("remove")))), lambda c: F.struct(c["index"].cast("int").alias("index"), c["product_name"].alias("product_name"), c["remove"].alias("remove"))).alias("changes"))
    loaded = products.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description", "product_name"))), lambda p: F.struct(p["description"].alias("description"), p["product_name"].alias("product_name"))).alias("products"))
    null: Column = F.lit(None)
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", route(F.col("text"), F.lit(True)).alias("intent")).join(of, ["conv_id", "turn"], "left")
    kind = "array<struct<description: string, product_name: string>>"
    rows = rows.withColumn("products", null.cast(kind))
    first = loaded.select("conv_id", F.lit(-(2**62)).cast("bigint").alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), null.cast("string").alias("intent"), null.cast(CHANGES).alias("changes"), "products")
    return rows.unionByName(first)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state = None, None
    for b in batches:
        rows, conv = [], []
        for r in b.itertuples(index=False):
            if state is None or r.conv_id != now:
                now, state = r.conv_id, Conversation()
            if told := state.take(str(r.conv_id), r):
                rows.append(told)
                conv.append(r.conv_id)
        yield _told(rows, conv)


def run_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, intent, hits, renamed, removed, rows_left, product_names of every user turn of :func:`events` rows; null
    conversations are left out."""
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.where("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(_fold, f"conv_id {kind}, {TOLD}")


def _step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    talk = Conversation(state.get[0] if state.exists else None)
    every = pd.concat(list(batches)).sort_values(["turn", "role", "text"], na_position="first")
    rows = [t for r in every.itertuples(index=False) if (t := talk.take(str(key[0]), r))]
    state.update((talk.stored(),))
    if rows:
        yield _told(rows, [key[0]] * len(rows))


def stream_turns(rows: DataFrame) -> DataFrame:
    """The same over a stream of events; turns of a conversation come in order from batch to batch."""
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.groupBy("conv_id").applyInPandasWithState(_step, f"conv_id {kind}, {TOLD}", "state string", "append", GroupStateTimeout.NoTimeout)

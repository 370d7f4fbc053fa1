"""Streams of chunks of text, cut anywhere: what may go on in the next chunk is carried to it in the stream's state.

A stream's chunks come in the order of `seq` over its batches; within a batch they are put in that order, so a source's limits of a
batch (maxFilesPerTrigger, maxBytesPerTrigger) bound what a task holds of a stream. `final` says that a chunk is the
stream's last one; what comes behind it begins anew. Null text is empty. Whatever the cuts, the texts given out in order are together
the same.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEFORE, BEHIND = re.compile(r"[\p{L}\p{M}\p{N}_]"), re.compile(r"[\p{L}\p{M}\p{N}_-]")


def with_state_store(spark: SparkSession) -> None:
    """Keyed state needs this store; the setting holds for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Restorer:
    """Values of a map in place of its tokens: of those that begin at a place, the longest that letters, digits, _ and, behind it, - don't touch."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.values = entries
        self.tokens = sorted(entries)  # those with a common beginning stand together, so a beginning is found by bisection
        self.firsts = {t[0] for t in self.tokens if t}
        self.longest = max(map(len, self.tokens), default=0)

    def begins(self, piece: str) -> bool:
        """Whether some token is longer than piece and begins with it."""
        i = bisect_left(self.tokens, piece)
        i += i < len(self.tokens) and self.tokens[i] == piece
        return i < len(self.tokens) and self.tokens[i].startswith(piece)

    def read(self, text: str, previous: str, final: bool) -> tuple[str, str, str]:
        """What can be given out, what is to be carried, and the character that stands before that."""
        out, at, last = [], 0, 0
        while at < len(text):
            if text[at] in self.firsts and not (previous and BEFORE.match(previous)):
                rest = text[at : at + self.longest + 1]
                if not final and at + len(rest) == len(text) and (rest in self.values or self.begins(rest)):
                    break  # more may come, of a token or behind it
                found = next((rest[:n] for n in range(min(len(rest), self.longest), 0, -1) if rest[:n] in self.values and not BEHIND.match(rest[n : n + 1] or " ")), None)
                if found:
                    out += [text[last:at], self.values[found]]
                    previous = found[-1]
                    last = at = at + len(found)
                    continue
            previous = text[at]
            at += 1
        return "".join([*out, text[last:at]]), text[at:], previous


class Boundary:
    """Where a text can be cut so that no quoted value, key block, entry of a netrc file or run of base64 lines is cut: at ends of lines.

    State goes from line to line, so what is held is never read again."""

    LINE64 = re.compile(r"[A-Za-z0-9+/_-]{1,128}={0,2}\r?\n?")
    OPEN, CLOSE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"), re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY-----")
    PUTTY, MAC = re.compile(r"PuTTY-User-Key-File-[23]:"), re.compile(r"Private-MAC:[ \t]*[0-9A-Fa-f]+")
    NETRC = [None, re.compile(r"[^\s\"'<>]+"), re.compile("login"), re.compile(r"[^\s\"'<>]+"), re.compile("password"), re.compile(r"\S+")]

    def __init__(self, state: str | None = None) -> None:
        #: quote: the open one; pem, putty: within such a block; netrc: what an entry expects next; lines: held from a first one of base64 on.
        self.quote, self.escaped, self.pem, self.putty, self.netrc, self.lines = json.loads(state) if state else ("", False, False, False, 0, False)

    def state(self) -> str:
        return json.dumps([self.quote, self.escaped, self.pem, self.putty, self.netrc, self.lines])

    def step(self, line: str) -> bool:
        """Reads a line; whether the text can be cut behind it, and before it if it begins a run of base64 lines."""
        if self.OPEN.search(line):
            self.pem = True
        if self.CLOSE.search(line):
            self.pem = False
        if self.PUTTY.match(line):
            self.putty = True
        if self.MAC.match(line):
            self.putty = False
        for token in line.split():
            expected = self.NETRC[self.netrc]
            if expected is not None and expected.fullmatch(token):
                self.netrc = (self.netrc + 1) % 6
            else:
                self.netrc = {"machine": 1, "default": 2}.get(token, 0)
        before = ""
        for c in line:
            if self.escaped:
                self.escaped = False
            elif c == "\\" and self.quote:
                self.escaped = True
            elif self.quote:
                self.quote = "" if c == self.quote else self.quote
            elif c == '"' or (c == "'" and not (before and (before.isalpha() or before.isdigit()))):
                self.quote = c
            before = c
        return not (self.quote or self.pem or self.putty or self.netrc)

    def read(self, text: str, done: int, final: bool) -> tuple[str, str, int]:
        """What can be given out of the held text, of which `done` characters (whole lines) were read before, what is to be carried, and how much of that is read."""
        at, cut = done, 0
        while at < len(text):
            end = text.find("\n", at) + 1
            if not end:
                if not final:
                    break
                end = len(text)
            line = text[at:end]
            is64 = bool(self.LINE64.fullmatch(line)) and (self.lines or len(line.strip("=\r\n")) >= 16)
            free_before = not (self.quote or self.pem or self.putty or self.netrc)
            if is64 and not self.lines and free_before:
                cut = at
            free = self.step(line)
            self.lines = is64
            if free and not is64:
                cut = end
            at = end
        if final:
            self.__init__()
            return text, "", 0
        return text[:cut], text[cut:], at - cut


def _ordered(rows: Iterator[pd.DataFrame], seq: str, text: str, final: str) -> list[tuple]:
    """seq, text and final of a stream's chunks of one batch in order, null seq last; as lists, since most streams have a few chunks."""
    each = [(n, t if isinstance(t, str) else "", last) for b in rows for n, t, last in zip(b[seq].tolist(), b[text].tolist(), b[final].tolist())]
    return sorted(each, key=lambda r: (True, 0, r[1]) if pd.isna(r[0]) else (False, r[0], r[1]))


def _keep(state, there: bool, value: tuple, empty: tuple) -> None:
    """value as the state, none for what a stream begins with: a stream that ended leaves nothing, and nothing is written where nothing was."""
    if value != empty:
        state.update(value)
    elif there:
        state.clear()


def restored_stream(rows: DataFrame, maps: DataFrame, stream: str, seq: str, text: str = "text", final: str = "final") -> DataFrame:
    """stream, seq and text of each chunk of a streaming DataFrame, with the values of its stream's map (rows of stream, token and value) in place of tokens.

    The map is the stream's first state, one list, and is read once a batch. The longest end of a chunk that may begin a token, or
    lacks only what stands behind it, is carried."""

    class Restoring(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.entries = handle.getListState("entries", "token string, value string")
            self.held = handle.getValueState("held", "carried string, previous string")

        def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
            made = [(token, value or "") for token, value in zip(initialState["token"], initialState["value"]) if token]
            if made:
                self.entries.appendList(made)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            restorer, out = Restorer(dict(map(tuple, self.entries.get()))), []
            held = self.held.get()
            carried, previous = held or ("", "")
            for n, t, last in _ordered(rows, seq, text, final):
                given, carried, previous = restorer.read(carried + t, previous, bool(last))
                carried, previous = ("", "") if last else (carried, previous)
                out.append((key[0], n, given))
            _keep(self.held, held is not None, (carried, previous), ("", ""))
            yield pd.DataFrame(out, columns=[stream, seq, text])

        def close(self) -> None:
            pass

    with_state_store(rows.sparkSession)
    kinds = dict(rows.dtypes)
    first = maps.select(stream, "token", "value").groupBy(stream)
    made = f"{stream} {kinds[stream]}, {seq} {kinds[seq]}, {text} string"
    return rows.select(stream, seq, text, final).groupBy(stream).transformWithStateInPandas(Restoring(), outputStructType=made, outputMode="append", timeMode="none", initialState=first)


def bounded_stream(rows: DataFrame, stream: str, seq: str, text: str = "text", final: str = "final", most: int = 32 * 1024 * 1024) -> DataFrame:
    """stream, seq, text and error of each chunk: the text that can be looked through by itself from there on, up to the end of a
    line outside quotes, key blocks, entries and runs of base64. The rest is carried to the next chunk.

    A stream of which more than `most` characters are held gives them out with ERR_LIMIT, and goes on from a clean state; others go on as they are."""

    class Bounding(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("held", "carried string, done long, state string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = self.held.get()
            carried, done, state = held or ("", 0, None)
            boundary, out = Boundary(state), []
            for n, t, last in _ordered(rows, seq, text, final):
                given, carried, done = boundary.read(carried + t, done, bool(last))
                error = None
                if len(carried) > most:
                    given, carried, done, error, boundary = given + carried, "", 0, "ERR_LIMIT", Boundary()
                out.append((key[0], n, given, error))
            _keep(self.held, held is not None, (carried, done, boundary.state()), ("", 0, Boundary().state()))
            yield pd.DataFrame(out, columns=[stream, seq, text, "error"]).astype({"error": object})

        def close(self) -> None:
            pass

    with_state_store(rows.sparkSession)
    kinds = dict(rows.dtypes)
    made = f"{stream} {kinds[stream]}, {seq} {kinds[seq]}, {text} string, error string"
    return rows.select(stream, seq, text, final).groupBy(stream).transformWithStateInPandas(Bounding(), outputStructType=made, outputMode="append", timeMode="none")

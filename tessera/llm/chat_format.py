r"""Prefix-target expansion of conversations.

Every assistant turn becomes one training example: the example's text is the
rendered conversation up to and including that turn, all earlier turns are
context, and only the reply's text lies under the loss mask.  Turns after the
last assistant turn (or a conversation without one) would appear in no
example, so they are kept in one closing example with an empty mask.

Template: ``<|turn|>role\ntext<|end|>\n`` per turn.  Control strings inside
roles and texts are escaped by a backslash after their first character
(``</s>`` becomes ``<\/s>``); an already escaped one gets one more backslash,
so ``unescape(escape(x)) == x`` for every text.

The work is one hash exchange on the conversation and a sort inside each
partition; Python then streams over the sorted rows and holds one
conversation's rendered prefix at a time, never a table of conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
CONTROL = [TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_TAILS = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)({_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
# rows of an output batch are flushed at this many characters
FLUSH_CHARS = 4_000_000

EXAMPLE_SCHEMA = ("conv_id long, example_no int, n_turns long, text string, "
                  "loss_start long, loss_end long, closing boolean")
DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long, n_examples long")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The rendered turn and the offset of its text inside it."""
    line = role.replace("\\", "\\\\").replace("\n", "\\n")
    head = f"{TURN}{escape(line)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendered text."""
    out = []
    for part in text.split(f"{END}\n")[:-1]:
        role, _, body = part[len(TURN):].partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        out.append((role, unescape(body)))
    return out


def _examples(batches: Iterator[pd.DataFrame], target_role: str) -> Iterator[pd.DataFrame]:
    cols = ["conv_id", "example_no", "n_turns", "text", "loss_start", "loss_end", "closing"]
    rows: list[tuple] = []
    chars = 0
    key: object = _examples          # no conversation yet
    prefix, n_turns, n_examples, pending = [], 0, 0, False

    def closing():
        text = "".join(prefix)
        return (key, n_examples, n_turns, text, len(text), len(text), True)

    for batch in batches:
        for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
            conv = None if pd.isna(conv) else int(conv)
            if conv != key:
                if pending:
                    rows.append(closing())
                    chars += len(rows[-1][3])
                key, prefix, n_turns, n_examples, pending = conv, [], 0, 0, False
            role, text = role or "", text or ""
            turn, at = render_turn(role, text)
            start = sum(map(len, prefix)) + at if role == target_role else 0
            prefix.append(turn)
            n_turns += 1
            pending = True
            if role == target_role:
                prefix = ["".join(prefix)]
                rows.append((key, n_examples, n_turns, prefix[0], start,
                             start + len(turn) - at - len(END) - 1, False))
                chars += len(prefix[0])
                n_examples += 1
                pending = False
            if chars >= FLUSH_CHARS:
                yield pd.DataFrame(rows, columns=cols).astype({"conv_id": "Int64"})
                rows, chars = [], 0
    if pending:
        rows.append(closing())
    if rows:
        yield pd.DataFrame(rows, columns=cols).astype({"conv_id": "Int64"})


def expand_targets(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One example per ``target_role`` turn: (conv_id, example_no, n_turns,
    text, loss_start, loss_end, closing); offsets are code points of ``text``.

    Null text or role counts as empty; a null ``conv_id`` is a conversation of
    its own; null turns come first; rows with equal (conv_id, turn) are
    ordered by (role, text), repeated rows stay repeated turns.  Other columns
    are ignored.  An empty table gives no rows.
    """
    turns = (conversations
             .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
             .repartition("conv_id")
             .sortWithinPartitions("conv_id", "turn", "role", "text")
             .select("conv_id", "role", "text"))
    return turns.mapInPandas(lambda it: _examples(it, target_role), EXAMPLE_SCHEMA)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key: object = _digest
    last, loss, loss_chars, chars, n = None, hashlib.sha256(), 0, 0, 0

    def finish():
        turns = parse_turns(last)
        h = hashlib.sha256()
        for role, text in turns:
            h.update(f"{role}\n{text}\n".encode("utf-8"))
        return key, len(turns), h.hexdigest(), loss_chars, loss.hexdigest(), chars, n

    def frame():
        return pd.DataFrame(done, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                           "formatted_chars", "n_examples"]).astype({"conv_id": "Int64"})

    done: list[tuple] = []
    for batch in batches:
        for conv, no, text, a, b in zip(batch["conv_id"], batch["example_no"], batch["text"],
                                        batch["loss_start"], batch["loss_end"]):
            conv = None if pd.isna(conv) else int(conv)
            if no == 0:
                if last is not None:
                    done.append(finish())
                key, loss, loss_chars, chars, n = conv, hashlib.sha256(), 0, 0, 0
            target = unescape(text[a:b])
            loss.update(target.encode("utf-8"))
            loss_chars += len(target)
            chars += len(text)
            n += 1
            last = text
        if len(done) >= 1000:
            yield frame()
            done = []
    if last is not None:
        done.append(finish())
    if done:
        yield frame()


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of every conversation, parsed back from its examples.

    Reads the rows of ``expand_targets`` in their order (conversation by
    conversation, examples ascending), so no exchange is needed.
    """
    return examples.mapInPandas(_digest, DIGEST_SCHEMA)

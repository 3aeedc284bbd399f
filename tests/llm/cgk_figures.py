"""The figures behind the choice of op10's search: python tests/llm/cgk_figures.py

A CGK walk reads a string with one pointer. At step t it puts out the character under the pointer, and a random bit of
(t, character) says whether the pointer moves on. Two strings within few edits, walked with the same bits, fall back into
step, so their outputs agree in many places; bit sampling then hashes a few places of the outputs."""

import math
import random
import time

import numpy as np

LETTERS = "etaoinshrdlucmfwypvbgkjqxz "
SAMPLED, WALKS, RECALL = 6, 12, 0.9


def walk(rows: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Outputs of a walk over each row of codes (0 after the end)."""
    bits = np.random.default_rng(seed).integers(0, 2, (steps, 128), dtype=np.int8)
    at, lines, out = np.zeros(len(rows), np.int64), np.arange(len(rows)), np.zeros((len(rows), steps), np.uint8)
    for t in range(steps):
        here = np.where(at < rows.shape[1], rows[lines, np.minimum(at, rows.shape[1] - 1)], 0)
        out[:, t] = here
        at += bits[t, here]
    return out


def coded(texts: list[str], width: int) -> np.ndarray:
    return np.array([[ord(c) for c in t[:width].ljust(width, "\0")] for t in texts], np.uint8)


def edited(text: str, edits: int, r: random.Random) -> str:
    out = list(text)
    for _ in range(edits):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        out[at : at + (kind != 0)] = [] if kind == 1 else [r.choice(LETTERS)]
    return "".join(out)


def main() -> None:
    r = random.Random(0)
    prose = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    for size in (60, 100, 200):
        items = [prose(size) for _ in range(300)]
        near, far = [edited(t, int(0.15 * size), r) for t in items], [prose(size) for _ in items]
        agree, strange, missed = [], [], np.zeros(len(items))
        for seed in range(WALKS):
            a, b, c = (walk(coded(x, size + size // 4), 3 * size, seed) for x in (items, near, far))
            text = a != 0
            share = ((a == b) & text).sum(axis=1) / text.sum(axis=1)
            agree.append(share.mean())
            strange.append((((a == c) & text).sum(axis=1) / text.sum(axis=1)).mean())
            missed += np.log1p(-np.minimum(share**SAMPLED, 1 - 1e-12))
        # tables a walk, so that a pair is missed by all tables of all walks in 1 - RECALL of the cases
        tables = next(n for n in range(1, 100_000) if 1 - np.exp(missed * n).mean() >= RECALL)
        print(f"{size} characters, 15 % edits: places that agree {np.mean(agree):.2f}, of strangers {np.mean(strange):.2f}; {WALKS} walks need {tables * WALKS} tables of {SAMPLED} places for recall {RECALL}")
    text = prose(400_000)
    codes = np.frombuffer(text.encode(), np.uint8)
    starts = np.flatnonzero(codes[:-200] == 32) + 1
    began = time.process_time()
    for a in range(0, len(starts), 4096):
        walk(codes[starts[a : a + 4096, None] + np.arange(125)], 300, 0)
    one = (time.process_time() - began) / len(text) * 1e9
    print(f"one walk of 300 steps from the starts of words: {one:.0f} CPU seconds a GB of text; {WALKS} walks {WALKS * one:.0f}" + (", " + str(math.ceil(WALKS * one / 400)) + " times the limit of 400"))


if __name__ == "__main__":
    main()

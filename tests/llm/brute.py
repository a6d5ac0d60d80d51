"""Plain versions of the operators over Python lists, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall(text or "")


def solid_lines(text):
    return [x.strip(WHITE) for x in (text or "").split("\n") if x.strip(WHITE)]


def repeated(token_lists, size):
    """For each token list, in corpus order, whether each token is covered by a window that starts earlier too."""
    seen, out = set(), []
    for tokens in token_lists:
        gone = [False] * len(tokens)
        for i in range(len(tokens) - size + 1):
            key = tuple(tokens[i:i + size])
            if key in seen:
                gone[i:i + size] = [True] * size
            seen.add(key)
        out.append(gone)
    return out


def runs(mask):
    out, start = [], None
    for i, m in enumerate([*mask, False]):
        if m and start is None:
            start = i
        if not m and start is not None:
            out.append((start, i - start))
            start = None
    return out

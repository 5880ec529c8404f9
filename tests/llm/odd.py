"""Rows and helpers for the tests of the operators."""

from __future__ import annotations

import zlib


def fold(doc_id, folds):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


#: Rows that every text operator must take: null id, null and empty text, repeated rows, a long text, odd characters.
ODD = [
    (None, None), (None, "alone without a name"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "same row twice here"), (5, "same row twice here"),
    (6, "ünïcödé 漢字 🙂 text with odd spaces"), (7, "long " * 3000 + "end"), (8, "long " * 3000 + "end"), (9, "UPPER lower UPPER lower"),
]

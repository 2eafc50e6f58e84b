"""Where the public tokenizer files are: an installed data package, never part of this repository."""

from __future__ import annotations

import public_tokenizers


def path(name: str) -> str:
    return public_tokenizers.path(name)

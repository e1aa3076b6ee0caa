"""Places of the public vocabulary files: a parameter everywhere, resolved on the machine that reads."""

from __future__ import annotations

import os


def resolve(name: str) -> str:
    """An absolute path as it is; a bare name in the folder of public tokenizer files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)

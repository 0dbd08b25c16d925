"""Where the vocabulary files of public tokenizers are; a folder can be given instead."""

from __future__ import annotations

import os


def path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)

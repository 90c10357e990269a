"""Where the public tokenizer vocabularies are; a parameter of every operator that uses one."""

from __future__ import annotations

import os


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder``, in $TOKENIZER_DIR, or in the installed package of vocabularies."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)

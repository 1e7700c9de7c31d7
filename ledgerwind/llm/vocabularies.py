"""Where the vocabulary files of public tokenizers lie; the folder is a parameter."""

from __future__ import annotations

import os

from ledgerwind.llm.pieces import Model

FOLDER = "/opt/tokenizers"
PIECE_MODEL = "piece_bpe_32k.model"


def default_model(folder: str = FOLDER) -> Model:
    return Model.load(os.path.join(folder, PIECE_MODEL))

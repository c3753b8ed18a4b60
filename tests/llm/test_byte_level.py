"""The rank form of a byte-level vocabulary gives the ids of the file's own library."""

import json

import pytest

pytest.importorskip("accountlens.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from accountlens.llm import queries  # noqa: E402
from accountlens.llm.byte_level import ByteLevelTokenizer  # noqa: E402


def test_every_character():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = queries.byte_level()
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}{c}." for c in characters[i : i + 64]) for i in range(0, len(characters), 64)]
    expected = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [ranks.ids(t) for t in texts] == expected
    assert [ranks.plain_ids(t) for t in texts] == expected


def test_special_tokens():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "x <|endoftext|> y<|endoftext|>"
    assert queries.byte_level().ids(text) == own.encode(text, add_special_tokens=False).ids
    own.encode_special_tokens = True
    assert queries.byte_level().plain_ids(text) == own.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "a.json").write_text(json.dumps(file))
    file["pre_tokenizer"]["add_prefix_space"] = False
    file["model"]["merges"] = file["model"]["merges"][::-1]
    (tmp_path / "b.json").write_text(json.dumps(file))
    for name in ("a.json", "b.json"):
        with pytest.raises(ValueError):
            ByteLevelTokenizer.read(str(tmp_path / name), public_tokenizers.PATTERN)

"""Token ids of texts by a public byte-level BPE vocabulary; tokenizers are read, never trained."""

from __future__ import annotations

import functools
import re

import numpy as np

#: The id that ends a document in flat token files (the vocabulary's `<|endoftext|>`).
END_OF_TEXT = 50256
#: Runs of white space (as the pattern means it) over which tiktoken's pattern may run out of stack.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@functools.lru_cache(maxsize=2)
def _by_ranks(path: str | None):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _by_json():
    """The tokenizer of the JSON file, which takes some 30 MB and is loaded when a text first needs it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """Ids (uint32) of a text; none for null. `path`: another ranks file.

    The ranks file and `byte_bpe_50k.json` are one vocabulary and give the same ids; the ranks are some
    three times as fast. Where a text spells out the special token, which only the JSON file knows, that
    file's tokenizer is used, so that the ids are always those of `byte_bpe_50k.json`. So it is where the
    ranks' encoder gives up, which it does over some 700,000 white-space characters in a row.
    """
    if not text:
        return np.zeros(0, np.uint32)
    if path is not None or "<|endoftext|>" not in text:
        fast = _by_ranks(path)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        except ValueError:
            if path is not None:
                return _ids_around_space(fast, text)
    return np.array(_by_json().encode(text, add_special_tokens=False).ids, np.uint32)


def _ids_around_space(fast, text: str) -> np.ndarray:
    """Ids by ranks that have no JSON file: a long run of white space is one piece, without its last character if more text follows."""
    found, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        found.append(fast.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        found.append(fast._encode_single_piece(text[run.start() : end].encode()))
        at = end
    found.append(fast.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate([np.asarray(x, np.uint32) for x in found])

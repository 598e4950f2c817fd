"""Fragments of the vocabulary that occur in the texts of a profile, found in one pass over each text.

Spark's ``contains`` reads a text once for every fragment.  Here batches of texts run through an
Aho-Corasick automaton of all fragments in a Python worker; without that library each fragment is looked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

TEXTS = ("full", "career", "skills", "trust")
PARTS = ("desc", "title")  # of a job
FOUND = ", ".join([*(f"{name} array<string>" for name in TEXTS),
                   f"jobs array<struct<{', '.join(f'{name}: array<string>' for name in PARTS)}>>"])


def fragments_of_texts(fragments) -> Column:
    """``FOUND`` of a profile: which of the given fragments occur in each of its texts, in no order.

    Texts and fragments are compared by their UTF-8 bytes, one character each, as ``contains`` does.
    """
    names = sorted(fragments)
    texts, parts = TEXTS, PARTS  # names of the worker's own, which then needs no module of this package

    def found(*columns: pa.Array) -> pa.Array:
        terms = [name.encode().decode("latin-1") for name in names]
        try:
            from ahocorasick import Automaton
        except ImportError:
            def hits(text: bytes) -> list[int]:
                text = text.decode("latin-1")
                return [i for i, term in enumerate(terms) if term in text]
        else:
            automaton = Automaton()
            for i, term in enumerate(terms):
                if term:
                    automaton.add_word(term, i)
            automaton.make_automaton()
            always = [i for i, term in enumerate(terms) if not term]

            def hits(text: bytes) -> list[int]:
                return [*always, *{i for _, i in automaton.iter(text.decode("latin-1"))}] if len(automaton) else always

        held = pa.array(names, pa.string())

        def lists(texts: list[bytes]) -> pa.Array:
            ends, flat = [0], []
            for text in texts:
                flat += hits(text)
                ends.append(len(flat))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held.take(pa.array(flat, pa.int32())))

        whole, jobs, ends = columns[:len(texts)], columns[len(texts):], [0]
        for job in jobs[0].to_pylist():
            ends.append(ends[-1] + len(job))
        of_jobs = pa.StructArray.from_arrays([lists(part.flatten().to_pylist()) for part in jobs], names=list(parts))
        return pa.StructArray.from_arrays(
            [*(lists(column.to_pylist()) for column in whole), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of_jobs)],
            names=[*texts, "jobs"])

    return F.arrow_udf(found, FOUND)(
        *[F.col(f"{name}_text").cast("binary") for name in texts],
        *[F.expr(f"transform(jobs, j -> cast(j.{name} as binary))") for name in parts])

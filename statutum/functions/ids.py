"""Addresses and keys: external ids, gazette addresses, content hashes and blob keys, event and case keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import ELI, whole


def _path(*parts) -> Column:
    """Parts joined by slashes; null if any is, since ``concat_ws`` alone would drop it."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    joined = [x for p in columns for x in (F.lit("/"), p.cast("string"))][1:]
    return F.concat(*joined)


def print_address(term: Column, number: Column) -> Column:
    return _path(F.concat(F.lit("term"), term.cast("string")), "print", number)


def parliament_address(term: Column, kind: str, key: Column) -> Column:
    """``term{t}/{kind}/{key}`` for prints, processes, clubs, members and proceedings."""
    return _path(F.concat(F.lit("term"), term.cast("string")), kind, key)


def voting_address(term: Column, proceeding: Column, voting: Column) -> Column:
    return _path(F.concat(F.lit("term"), term.cast("string")), "proceeding", proceeding, "voting", voting)


def project_address(slug: Column, project: Column, catalog: Column | None = None, register: bool = False) -> Column:
    """``projekt/{slug}/{id}``, with ``/katalog/{catalog}`` and ``/rejestr`` where wanted."""
    parts = ["projekt", slug, project, *(["katalog", catalog] if catalog is not None else []), *(["rejestr"] if register else [])]
    return _path(*parts)


def eli(publisher: Column, year: Column, position: Column) -> Column:
    return _path(publisher, year, position)


def is_eli(value: Column) -> Column:
    return whole(value, ELI)


def publisher_of(address: Column) -> Column:
    return F.when(is_eli(address), F.substring_index(address, "/", 1))


def content_hash(payload: Column) -> Column:
    """SHA-256 of bytes as 64 lower-case hex characters."""
    return F.sha2(payload.cast("binary"), 256)


def is_content_hash(value: Column) -> Column:
    return whole(value, "[0-9a-f]{64}")


def blob_key(digest: Column) -> Column:
    """``aa/bb/digest``: blobs lie in 65,536 folders."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def stable_id(*parts: Column) -> Column:
    """An id that depends on natural keys alone, so that a replay gives the same; unlike keys never share text."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def event_key(kind: Column, subject: Column, stage: Column) -> Column:
    """Names a piece of news: an act once, a draft once for each stage."""
    return F.when(kind == "act", F.concat(F.lit("act:"), subject)).otherwise(F.concat(F.lit("draft:"), subject, F.lit("@"), F.coalesce(stage, F.lit("unknown"))))


def case_key(kind: Column, subject: Column) -> Column:
    return F.concat(kind, F.lit(":"), subject)


def email_address(value: Column) -> Column:
    return F.lower(F.trim(value))

"""Literature XML fragments to structs. Spark's own XML reader breaks mixed content, so a small parser runs in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schemas import ARTICLE_PARTS, parsed
from .vectors import slices


#: A document type stands before the root element, after nothing but instructions and comments; elsewhere it is text.
_DTD = re.compile(r"\s*(?:(?:<\?.*?\?>|<!--.*?-->)\s*)*<!DOCTYPE", re.S)


def _text(node: ElementTree.Element | None) -> str | None:
    return None if node is None else "".join(node.itertext()).strip()


def _all(node: ElementTree.Element, path: str) -> list[ElementTree.Element]:
    return node.findall(f".//{path}")


def parse_article(xml: str | None) -> dict | None:
    """Parts of one ``<PubmedArticle>``. Broken XML, and any with a DTD, where entities are declared, gives None."""
    if not xml or _DTD.match(xml):
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    sections = [{"label": n.get("Label"), "body": _text(n)} for n in _all(root, "Abstract/AbstractText")]
    return {
        "pmid": _text(root.find(".//MedlineCitation/PMID")),
        "title": _text(root.find(".//Article/ArticleTitle")),
        "sections": [s for s in sections if s["body"]],
        "journal": _text(root.find(".//Journal/Title")),
        "year": _text(root.find(".//JournalIssue/PubDate/Year")),
        "medline_date": _text(root.find(".//JournalIssue/PubDate/MedlineDate")),
        "authors": [{"last_name": _text(n.find("LastName")), "initials": _text(n.find("Initials"))} for n in _all(root, "AuthorList/Author")],
        "publication_types": [_text(n) for n in _all(root, "PublicationTypeList/PublicationType")],
        "ids": [{"kind": n.get("IdType"), "value": _text(n)} for n in _all(root, "ArticleIdList/ArticleId")],
    }


def with_article_parts(df: DataFrame, column: str, name: str, read: bool = True) -> DataFrame:
    """The rows whose fragment is an article, without the fragment but with ``name``, a struct of its parts (schemas.ARTICLE_PARTS);
    with ``read`` false those whose fragment isn't, as they are.

    A fragment is parsed once, and a worker has the parts of a few in hand, not of a whole batch: filters that Spark moved
    below a function of columns would call it again there.
    """
    kind = to_arrow_type(parsed(ARTICLE_PARTS))
    kept = [c for c in df.columns if not read or c != column]
    schema = T.StructType([df.schema[c] for c in kept] + ([T.StructField(name, parsed(ARTICLE_PARTS))] if read else []))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
            for i, j in slices(sizes):
                some = b.slice(i, j - i)
                parts = [parse_article(x) for x in some.column(column).to_pylist()]
                rows = some.filter(pa.array([(p is not None) == read for p in parts], pa.bool_())).select(kept)
                found = [pa.array([p for p in parts if p is not None], kind)] if read else []
                yield pa.RecordBatch.from_arrays([*rows.columns, *found], [*kept, *([name] if read else [])])

    return df.mapInArrow(parse, schema)

"""Controlled vocabularies and names of the metadata pipelines; all can be exchanged by parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Kind of a publication by source item type.
PUBLICATION_KINDS = {
    "book": "bibo:Book",
    "bookSection": "bibo:BookSection",
    "conferencePaper": "bibo:Article",
    "document": "bibo:Document",
    "journalArticle": "bibo:AcademicArticle",
    "preprint": "bibo:Manuscript",
    "presentation": "bibo:Slideshow",
    "report": "bibo:Report",
    "thesis": "bibo:Thesis",
    "webpage": "bibo:Webpage",
}

#: Role of a creator by source creator type.
CREATOR_ROLES = {
    "artist": "marcrel:art",
    "author": "marcrel:aut",
    "bookAuthor": "marcrel:aut",
    "contributor": "marcrel:ctb",
    "editor": "marcrel:edt",
    "performer": "marcrel:prf",
    "presenter": "marcrel:pre",
    "programmer": "marcrel:prg",
    "recipient": "marcrel:rcp",
    "seriesEditor": "marcrel:edt",
    "sponsor": "marcrel:spn",
    "translator": "marcrel:trl",
}

#: Kinds of instruments and venues, the publishing event, and the fields that a conflict report compares.
SOFTWARE_KIND, JOURNAL_KIND, PROCEEDINGS_KIND, PUBLISHING = "obo:IAO_0000010", "bibo:Journal", "bibo:Proceedings", "obo:IAO_0000444"
CONFLICT_FIELDS = ["itemType", "title", "date", "publicationTitle", "DOI", "url"]
COMPLETENESS_FIELDS = ["title", "abstractNote", "DOI", "url", "date", "publicationTitle", "ISSN", "ISBN", "language", "rights"]

#: Predicate of a top-level field, by which a source's value is asserted.
FIELD_PREDICATES = {
    "title": "dlthings:title",
    "display_label": "skos:prefLabel",
    "description": "dcterms:description",
    "name": "dlthings:name",
    "short_name": "dlthings:short_name",
    "given_name": "dlthings:given_name",
    "family_name": "dlthings:family_name",
    "formatted_name": "dlthings:formatted_name",
    "additional_names": "dlthings:additional_names",
    "nickname": "dlthings:nickname",
    "broad_mappings": "skos:broadMatch",
    "kind": "dcterms:type",
    "about": "dcterms:subject",
    "at_location": "dlthings:at_location",
    "part_of": "dlthings:part_of",
}

CLASSES = ("Dataset", "Document", "Instrument", "Publication", "PublicationVenue")

#: A source item as the transform reads it.
ITEM = (
    "key STRING, version BIGINT, itemType STRING, deleted BOOLEAN, collections ARRAY<STRING>, title STRING, abstractNote STRING, DOI STRING, url STRING, "
    "date STRING, publicationTitle STRING, proceedingsTitle STRING, ISSN STRING, ISBN STRING, language STRING, rights STRING, volume STRING, issue STRING, "
    "pages STRING, extra STRING, creators ARRAY<STRUCT<creatorType: STRING, firstName: STRING, lastName: STRING, name: STRING>>, tags ARRAY<STRUCT<tag: STRING>>"
)


@dataclass(frozen=True)
class Options:
    """How a library's items are read. Collection names are compared after label_key with `label_prefix`."""

    group: int
    root: str = "https://api.example.org/groups"
    scheme: str = "library"
    included: tuple[str, ...] = ()
    document_classes: dict[str, str] = field(default_factory=dict)
    label_prefix: str = ""
    namespace: str = "dlthings:"

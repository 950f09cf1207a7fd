"""The file kinds that are read, by extension."""

from __future__ import annotations

CODE = frozenset("c cpp cs go h java js php py rb rs ts".split())
PLAIN = frozenset("log md rst tex txt yaml yml".split()) | CODE
IMAGES = frozenset("bmp jpeg jpg png tif tiff webp".split())
MARKUP = frozenset("csv htm html json ndjson xml".split())
OFFICE = frozenset("docx odp ods odt pptx xls xlsx".split())
LEGACY = frozenset("doc ppt".split())
MAIL = frozenset("eml mbox msg".split())
OTHER = frozenset("epub pdf rtf zip".split())
SUPPORTED = PLAIN | IMAGES | MARKUP | OFFICE | LEGACY | MAIL | OTHER


def is_supported(ext: str) -> bool:
    return ext.lower() in SUPPORTED


def is_plain_text(ext: str) -> bool:
    return ext.lower() in PLAIN


def is_image(ext: str) -> bool:
    return ext.lower() in IMAGES

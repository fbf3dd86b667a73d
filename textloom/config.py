"""Options of the operators, with the implications between them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

FORMATS = ("txt", "xml", "json", "vertical", "conllu")


@dataclass(frozen=True)
class TokenizeConfig:
    words: bool = False
    only_words: bool = False
    preserve_whitespace: bool = False
    newline: str = " "
    separator: str | None = None
    output: str = "txt"

    def __post_init__(self):
        if self.output not in ("txt", "xml", "json"):
            raise ValueError(f"output {self.output!r}")

    def adjusted(self) -> TokenizeConfig:
        """only_words implies words."""
        return replace(self, words=self.words or self.only_words)


@dataclass(frozen=True)
class CleanConfig:
    min_words: int = 0
    simple: bool = False
    allow_two_columns: bool = False
    mark_languages: str = "none"
    paragraph_delimiter: str = "auto"
    disabled_rules: frozenset[str] = field(default_factory=frozenset)
    merge_broken_i: bool = False
    #: Take out the footers of journal pages, abstracts and lists of references.
    journal: bool = False
    #: Part headings and long sentences of texts that are one long line.
    split_long_lines: bool = False
    #: Texts longer than this are taken apart at line ends for the steps that rewrite them, and put
    #: together again; 0 leaves them whole.
    chunk_chars: int = 0

    def __post_init__(self):
        if self.mark_languages not in ("none", "mark", "cut"):
            raise ValueError(f"mark_languages {self.mark_languages!r}")
        if self.paragraph_delimiter not in ("auto", "single_nl", "double_nl"):
            raise ValueError(f"paragraph_delimiter {self.paragraph_delimiter!r}")


@dataclass(frozen=True)
class TagConfig:
    output: str = "xml"
    token_format: bool = False
    lemma_only: bool = False
    single_token_only: bool = False
    all_token_readings: bool = False
    disambiguate: bool = False
    no_disambig: bool = False
    show_rate: bool = False
    tag_unknown: bool = False
    unknown_rate: bool = False
    set_lemma_for_unknown: bool = False
    show_level: bool = False
    semantic_tags: bool = False
    split_hyphen_parts: bool = True
    sentence_per_line: bool = False
    strip_control: bool = False
    modules: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if self.output not in FORMATS:
            raise ValueError(f"output {self.output!r}")
        if self.modules - {"zheleh", "lesya"}:
            raise ValueError(f"modules {sorted(self.modules)}")

    def adjusted(self) -> TagConfig:
        """lemma_only implies txt, disambiguate and a single token; txt, vertical and conllu imply
        lemmas for unknown words; vertical and conllu also disambiguate with rates, unless
        no_disambig is set; conllu leaves particles with their words; rates imply disambiguate, which implies the
        token format, guesses for unknown words and, but for all_token_readings, one token."""
        c = self
        if c.lemma_only:
            c = replace(c, output="txt", disambiguate=True, single_token_only=True)
        if c.output in ("txt", "vertical", "conllu"):
            c = replace(c, set_lemma_for_unknown=True)
        if c.output in ("vertical", "conllu") and not c.no_disambig:
            c = replace(c, disambiguate=True, show_rate=True)
        if c.output == "conllu":
            c = replace(c, split_hyphen_parts=False)
        if c.show_rate or c.disambiguate:
            c = replace(c, disambiguate=True, token_format=True, tag_unknown=True, single_token_only=c.single_token_only or not c.all_token_readings)
        return replace(c, token_format=c.token_format or c.single_token_only, tag_unknown=c.tag_unknown or c.unknown_rate)

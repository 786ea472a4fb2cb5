"""Options with the defaults that change results; each checks its values when it is made."""

from __future__ import annotations

from dataclasses import dataclass, field

from papyra.export.markdown import IGNORED


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class RecognitionOptions:
    """How crops are read and their lines grouped."""

    # fixed values
    grouping: str = "Line"
    batch_size: int = 6
    drop_score: float = 0.0
    orientation_threshold: float = 0.9
    verify_orientation_by_recognition: bool = True
    use_document_orientation: bool = True
    use_document_unwarp: bool = False
    space_recovery: float = 0.0
    long_line_overlap: float = 0.2
    most_long_line_segments: int = 64

    def __post_init__(self):
        _need(self.grouping in ("Line", "Paragraph"), "grouping is Line or Paragraph")
        _need(self.batch_size >= 1 and self.most_long_line_segments >= 1, "sizes are 1 or more")
        _need(all(0 <= x <= 1 for x in (self.drop_score, self.orientation_threshold, self.space_recovery)) and 0 <= self.long_line_overlap < 1, "scores and shares are from 0 to 1")


@dataclass(frozen=True)
class DetectionOptions:
    """How text regions are found on a page."""

    # fixed values
    least_side: int = 64
    most_side: int = 4000
    pixel_threshold: float = 0.3
    box_threshold: float = 0.6
    unclip_ratio: float = 1.5
    least_box: int = 3
    most_iou: float = 0.0
    tiling: bool = False

    def __post_init__(self):
        _need(1 <= self.least_side <= self.most_side and self.least_box >= 1, "sides are 1 or more, the least at most the most")
        _need(all(0 <= x <= 1 for x in (self.pixel_threshold, self.box_threshold, self.most_iou)) and self.unclip_ratio > 0, "thresholds are from 0 to 1, the ratio above 0")


@dataclass(frozen=True)
class PreprocessingOptions:
    """What is done to pixels before detection, in this order."""

    denoise: bool = False
    deskew: bool = False
    binarize: bool = False
    detect_orientation: bool = False
    correct_non_square_pixels: bool = True


@dataclass(frozen=True)
class StructureOptions:
    """How a page's layout becomes blocks. No merge mode means that of each class."""

    # fixed values
    layout_score: float = 0.5
    layout_nms: bool = True
    overlap_filter: bool = True
    merge_mode: str | None = None
    reading_order: str = "Auto"
    table_model: str = "SLANet-plus"
    recognize_tables: bool = True
    recognize_formulas: bool = True
    recognize_seals: bool = True
    language: str = "ch"

    def __post_init__(self):
        _need(0 <= self.layout_score <= 1, "scores are from 0 to 1")
        _need(self.merge_mode in (None, "large", "small", "union"), "merge_mode is large, small, union or none")


@dataclass(frozen=True)
class MarkdownOptions:
    """How pages become Markdown: furniture is left out, no separator splices pages."""

    ignored: tuple[str, ...] = tuple(IGNORED)
    pretty_tables: bool = True
    page_separator: str | None = None


@dataclass(frozen=True)
class LayoutTextOptions:
    """How lines become text in columns of characters."""

    blank_lines: int = 1
    row_overlap: float = 0.5
    right_align_rtl: bool = True

    def __post_init__(self):
        _need(self.blank_lines >= 0 and 0 < self.row_overlap <= 1, "blank_lines is 0 or more, row_overlap from 0 to 1")


@dataclass(frozen=True)
class PdfOptions:
    """How PDF files become pages."""

    # fixed values
    dpi: int = 200
    text_layer: str = "Ignore"
    jpeg_quality: int = 75
    most_pages: int = 5000
    most_pixels: int = 200_000_000

    def __post_init__(self):
        _need(self.text_layer in ("Ignore", "Prefer", "Auto", "Hybrid"), "text_layer is Ignore, Prefer, Auto or Hybrid")
        _need(self.dpi >= 1 and 1 <= self.jpeg_quality <= 100 and self.most_pages >= 1 and self.most_pixels >= 1, "sizes are 1 or more, the quality at most 100")


#: Extra passes of the profiles.
PASSES = {"Fast": 0, "Balanced": 1, "Accurate": 2}


@dataclass(frozen=True)
class ProcessingPolicy:
    """How much more work a page may have when its reading is weak, and when a person should look at it."""

    # fixed values
    profile: str = "Balanced"
    most_extra_passes: int | None = None
    most_extra_pixels: int = 40_000_000
    most_seconds: float = 30.0
    review_below: float = 0.85
    detection_rescan: bool = False
    most_rescan_regions: int = 32
    small_text_height: float = 16.0

    def __post_init__(self):
        _need(self.profile in PASSES, f"profile is one of {', '.join(PASSES)}")
        _need(self.most_extra_passes is None or self.most_extra_passes >= 0, "passes are 0 or more")
        _need(min(self.most_extra_pixels, self.most_seconds, self.most_rescan_regions, self.small_text_height) >= 0 and 0 <= self.review_below <= 1, "budgets are 0 or more, confidences from 0 to 1")

    @property
    def extra_passes(self) -> int:
        return PASSES[self.profile] if self.most_extra_passes is None else self.most_extra_passes


@dataclass(frozen=True)
class VerificationPolicy:
    """Budgets of a verification."""

    # fixed values
    most_rules: int = 64
    most_references: int = 256
    most_rereads: int = 16
    most_pixels: int = 16_000_000

    def __post_init__(self):
        _need(min(vars(self).values()) >= 0, "budgets are 0 or more")


@dataclass(frozen=True)
class TextNormalization:
    """Steps that text takes, in this order; none unless asked for."""

    unicode: bool = False
    line_ends: bool = False
    hyphens: bool = False
    space: bool = False


@dataclass(frozen=True)
class RoutingOptions:
    """How a page's recogniser is chosen: 0 packs means all; curves are knots by pack."""

    most_packs: int = 0
    evaluate_all: bool = True
    curves: dict[str, list[tuple[float, float]]] = field(default_factory=dict)

    def __post_init__(self):
        _need(self.most_packs >= 0, "most_packs is 0 or more")
        _need(all(len(k) >= 2 and list(k) == sorted(k) and all(0 <= y <= 1 for _, y in k) for k in self.curves.values()), "curves are ascending knots of two or more")

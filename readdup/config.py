"""Options of a duplicate-marking run, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

SUM_OF_BASE_QUALITIES, TOTAL_MAPPED_REFERENCE_LENGTH, RANDOM = "sum_of_base_qualities", "total_mapped_reference_length", "random"
DONT_TAG, OPTICAL_ONLY, ALL = "dont_tag", "optical_only", "all"
COORDINATE, QUERYNAME = "coordinate", "queryname"
SORT_ORDERS = ("unknown", "unsorted", QUERYNAME, COORDINATE)
DEFAULT_NAMES = "default"


@dataclass
class Options:
    """One run. Engine knobs of a single-node program (file handles, buffer ratios, memory) are Spark's and are not here."""

    # input and output
    input: list[str] = field(default_factory=list)
    output: str | None = None
    metrics_file: str | None = None
    comment: list[str] = field(default_factory=list)
    # rules
    duplicate_scoring_strategy: str = SUM_OF_BASE_QUALITIES
    #: ``default`` splits names at colons; another text is a pattern whose first three groups are tile, x and y; empty means no locations.
    read_name_regex: str = DEFAULT_NAMES
    optical_distance: int = 100
    max_optical_set_size: int = 300_000
    tag_duplicate_set_members: bool = False
    tagging_policy: str = DONT_TAG
    clear_dt: bool = True
    remove_duplicates: bool = False
    remove_sequencing_duplicates: bool = False
    # barcodes
    barcode_tag: str | None = None
    duplex_umi: bool = False
    read_one_barcode_tag: str | None = None
    read_two_barcode_tag: str | None = None
    molecular_identifier_tag: str | None = None
    # flow reads
    flow_mode: bool = False
    use_unpaired_clipped_end: bool = False
    flow_skip_first_n_flows: int = 0
    flow_q_is_known_end: bool = False
    flow_quality_sum_strategy: bool = False
    flow_effective_quality_threshold: int = 15
    unpaired_end_uncertainty: int = 0
    use_end_in_unpaired_reads: bool = False
    # order
    assume_sorted: bool = False
    assume_sort_order: str | None = None
    # program group
    program_record_id: str | None = "MarkDuplicates"
    program_group_version: str | None = None
    program_group_command_line: str | None = None
    program_group_name: str = "MarkDuplicates"
    add_pg_tag_to_reads: bool = True

    def __post_init__(self) -> None:
        if self.duplicate_scoring_strategy not in (SUM_OF_BASE_QUALITIES, TOTAL_MAPPED_REFERENCE_LENGTH, RANDOM):
            raise ValueError(f"no such scoring strategy: {self.duplicate_scoring_strategy}")
        if self.tagging_policy not in (DONT_TAG, OPTICAL_ONLY, ALL):
            raise ValueError(f"no such tagging policy: {self.tagging_policy}")
        if self.assume_sorted and self.assume_sort_order is None:
            self.assume_sort_order = COORDINATE
        if self.unpaired_end_uncertainty and not self.use_end_in_unpaired_reads:
            raise ValueError("an uncertainty of unpaired ends needs use_end_in_unpaired_reads")

    @property
    def use_barcodes(self) -> bool:
        return any((self.barcode_tag, self.read_one_barcode_tag, self.read_two_barcode_tag))

    @property
    def need_optical_ids(self) -> bool:
        return self.remove_sequencing_duplicates or self.tagging_policy != DONT_TAG

    def sort_order(self, header_order: str | None) -> str:
        """The order that holds for the run: the assumed one, else the header's; neither coordinate nor queryname is an error, told before any work."""
        order = self.assume_sort_order or header_order
        if order not in SORT_ORDERS:
            raise ValueError(f"the header's sort order is missing or unknown: {order}")
        if order not in (COORDINATE, QUERYNAME):
            raise ValueError("the input must be sorted by coordinate or queryname, or assume_sort_order be given")
        return order

    def only_input(self) -> str:
        if len(self.input) != 1:
            raise ValueError(f"exactly one input is expected, not {len(self.input)}")
        return self.input[0]

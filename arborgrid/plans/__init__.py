"""Helpers about physical behaviour: materialising, ranking without hot tasks, size checks."""

from arborgrid.plans.runtime import Scratch, bounded_broadcast, checkpoint_dir
from arborgrid.plans.ranking import grouped_rank, take_smallest
from arborgrid.plans.skew import lookup

__all__ = ["Scratch", "bounded_broadcast", "checkpoint_dir", "grouped_rank", "lookup", "take_smallest"]

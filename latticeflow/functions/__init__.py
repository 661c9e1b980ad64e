"""Column functions: lattices, circular statistics, text and paths."""

from .circular import circular_distance, circular_mean, circular_variance
from .lattice import nearest_phrase, octave_ratio, phrase_offset, snap_nonnegative, snap_phrase
from .text import event_note, file_url_path, minutes_seconds, pad_letter, pad_number

__all__ = [
    "circular_distance", "circular_mean", "circular_variance", "event_note", "file_url_path", "minutes_seconds", "nearest_phrase",
    "octave_ratio", "pad_letter", "pad_number", "phrase_offset", "snap_nonnegative", "snap_phrase",
]

from rowassay.functions.ids import add_row_ids
from rowassay.functions.select import Selection, half_even

__all__ = ["Selection", "add_row_ids", "half_even"]

from rowassay.streaming.flag import StatefulRule, flag_stream

__all__ = ["StatefulRule", "flag_stream"]

"""Analytics over source-code facts, text assets and tool-call logs, as DataFrame plans."""

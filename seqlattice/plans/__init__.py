"""Parameter derivation and query composition on the driver."""

"""Analytics over text memories, events and code corpora, planned by Catalyst."""

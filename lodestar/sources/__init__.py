"""Sources: a catalogue, parsers of captured payloads, HTML extractors and a data source that reads them live."""

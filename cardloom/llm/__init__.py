"""Training-data operators over the text that hangs on cards: strip transcripts
(``strip_id, text, source``), worker dialogues (``pull_id, row_index, role, text``), fetched
card responses, listing pages and art vectors. Nothing outside this package imports it."""

"""DataFrame functions of document curation."""

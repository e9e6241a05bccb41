"""Readers and writers: corpora, configuration files, scan history, fingerprint sets."""

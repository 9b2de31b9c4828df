"""Operators over alignments: filters, weights, frequencies, couplings, spectra, sectors, graphs."""

"""DataFrame-to-DataFrame operators: pairing, scoring, matching, roll-ups, ranking."""

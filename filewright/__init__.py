"""File rename planning and duplicate detection as DataFrame plans."""

"""tesserae: document-overlap detection and rubric analytics as DataFrame operators."""

"""Report documents and exports."""

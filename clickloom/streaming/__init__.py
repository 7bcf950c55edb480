"""Ad-click streams."""
